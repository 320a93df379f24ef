import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import names, values
from lodestar.operators import cohort, overlap, ranking, splits, surface
from lodestar.operators.order import places


def test_evenly_spaced_is_truncated_linspace(spark):
    pairs = [(n, k) for n in (1, 2, 5, 31, 32, 100) for k in (1, 2, 3, 7, 23, 31, 40)]
    rows = spark.createDataFrame([(n, k, r) for n, k in pairs for r in range(n)], "n int, k int, r int")
    kept = {}
    for x in rows.where(values.evenly_spaced(F.col("r"), F.col("n"), F.col("k"))).collect():
        kept.setdefault((x.n, x.k), []).append(x.r)
    for n, k in pairs:
        want = list(range(n)) if n <= k else sorted({0} if k == 1 else set(np.linspace(0, n - 1, k, dtype=int).tolist()))
        assert sorted(kept[n, k]) == want


def test_labels_and_names(spark):
    rows = spark.createDataFrame([(-5,), (0,), (1,), (99,), (100,), (101,), (199,), (200,)], "x int")
    assert [r[0] for r in rows.select(values.map_label(F.col("x"))).collect()] == [0, 0, 1, 1, 2, 0, 0, 3]
    row = spark.createDataFrame([("1_t2_SPACE_slice_000.npz",), ("7_t1_s012.npz",)], "n string").select(names.series_id(F.col("n")), names.sequence_of(F.col("n")), names.slice_index(F.col("n")), names.patient_id(F.col("n"))).collect()
    assert [tuple(r) for r in row] == [("1_t2_SPACE", "T2_SPACE", -1, "1"), ("7_t1", "T1", 12, "7")]


def test_audit_adds_up(spark):
    rows = spark.createDataFrame([(s, "g", c) for s in range(40) for c in ("ABC"[: 1 + s % 3])], "s int, g string, c string")
    stats = cohort.class_stats(rows, ["s", "g"], "c", list("ABC"))
    out = cohort.filter_audit(stats, "g", [cohort.FilterConfig("x", 2, 0.4, 3), cohort.FilterConfig("y", 1, 1.0, None)]).collect()
    assert all(r.extracted == r.removed_class + r.removed_imbalance + r.removed_cap + r.kept == 40 for r in out)
    assert {r.config: r.kept for r in out} == {"x": 3, "y": 40}


def test_surface_distances_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        p, t = rng.random((2, 7, 9)) < 0.5
        a, b = np.argwhere(surface.surface(p)) * (0.5, 0.6), np.argwhere(surface.surface(t)) * (0.5, 0.6)
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        assert np.allclose(np.sort(surface.surface_distances(p, t, (0.5, 0.6))), np.sort(np.concatenate([d.min(1), d.min(0)])))
    wide = rng.random((2, 40, 600)) < 0.01  # more pixels asked for than one part holds
    a, b = (np.argwhere(x) for x in wide)
    far = np.sqrt((((a[:, None] - b[None]) * (2.0, 0.3)) ** 2).sum(-1)).min(1)
    assert np.allclose(surface.distance_to(wide[1], (2.0, 0.3), wide[0]), far)
    none, some = np.zeros((3, 3)), np.ones((3, 3))
    assert surface.metrics_of(none, none, (1, 1), 1) == (0, 0, 0, 1)
    assert surface.metrics_of(none, some, (1, 1), 1) == (float("inf"),) * 3 + (0.0,)


def test_null_masks_have_null_distances(spark):
    rows = spark.createDataFrame([(1, [1, 1, 0, 0], None), (2, None, None), (3, [1, 1, 0, 0], [1, 1, 0, 0]), (4, [1, 0, 0, 0], [0, 0, 0, 0])], "id int, p array<int>, t array<int>")
    out = {r.id: tuple(r)[1:] for r in surface.surface_metrics(rows, "id", "p", "t", (2, 2), (1, 1), 1).collect()}
    assert out == {1: (None,) * 4, 2: (None,) * 4, 3: (0.0, 0.0, 0.0, 1.0), 4: (float("inf"),) * 3 + (0.0,)}


def test_places_without_one_task(spark):
    rows = spark.createDataFrame([(g, i * 7 % 101) for g in ("a", "b", None) for i in range(60 if g == "a" else 5)], "g string, x int").repartition(5)
    got = {}
    for r in places(rows, ["g"], ["x"]).collect():
        got.setdefault(r.g, []).append((r.place, r.x, r.members))
    for g, found in got.items():
        n = 60 if g == "a" else 5
        assert [k for k, *_ in sorted(found)] == list(range(n)) and [x for _, x, _ in sorted(found)] == sorted(i * 7 % 101 for i in range(n)) and {m for *_, m in found} == {n}
    assert [r.place for r in places(rows, [], ["x", "g"]).orderBy("place").collect()] == list(range(70))
    assert places(rows.limit(0), ["g"], ["x"]).count() == 0


def test_audit_equals_ranked_samples_and_counts_splits(spark):
    rows = spark.createDataFrame([(s, "gh"[s % 2], s % 7, c) for s in range(80) for c in ("ABC"[: 1 + s % 3])], "s int, g string, series int, c string")
    stats = cohort.class_stats(rows, ["s", "g", "series"], "c", list("ABC"))
    overview = spark.createDataFrame([(0, "training"), (1, "validation"), (2, "training"), (2, "validation")], "name int, subset string")
    configs = [cohort.FilterConfig("x", 2, 0.6, 5), cohort.FilterConfig("none", 9, 0.1, 1)]
    out = {(r.config, r.g): r for r in splits.audit(stats, "g", "s", configs, "series", overview, "name", "subset").collect()}
    for g in "gh":
        kept = [r for r in cohort.filter_samples(stats.where(F.col("g") == g), "g", "s", configs[0]).where("reason is null").collect()]
        r = out["x", g]
        assert r.kept == len(kept) == 5 and r.extracted == r.removed_class + r.removed_imbalance + r.removed_cap + r.kept == 40
        assert (r.train, r.validation, r.unmatched) == (sum(k.series in (0, 2) for k in kept), sum(k.series in (1, 2) for k in kept), sum(k.series > 2 for k in kept))
        assert (out["none", g].kept, out["none", g].train, out["none", g].removed_class) == (0, 0, 40)


def test_arrays_count_as_exploded_pixels_do(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.integers(0, 4, 12).tolist(), rng.integers(0, 4, 12).tolist()) for i in range(6)]
    rows = spark.createDataFrame([*data, (9, None, None)], "s int, p array<int>, t array<int>")
    pixels = spark.createDataFrame([(i, a, b) for i, p, t in data for a, b in zip(p, t, strict=True)], "s int, p int, t int")
    counted = {tuple(r) for r in overlap.array_counts(rows, ["s"], "p", "t", 4).collect()}
    assert counted == {tuple(r) for r in overlap.counts(pixels, ["s"], "p", "t", 4).collect()} | {(9, k, 0, 0, 0) for k in range(4)}
    stats = {tuple(r) for r in cohort.array_stats(rows.where("s < 9"), ["s"], "t", 4).collect()}
    assert stats == {tuple(r) for r in cohort.class_stats(pixels, ["s"], "t", [0, 1, 2, 3], (0,)).collect()}
    assert cohort.array_stats(rows.where("s = 9"), ["s"], "t", 4).first().dominant_foreground == 1.0


def test_perfect_prediction_and_units(spark):
    rows = spark.createDataFrame([(s, s % 2, c, c) for s in range(4) for c in (0, 1, 2, 2)], "s int, k int, p int, t int")
    counted = overlap.counts(rows, ["s", "k"], "p", "t", 4)
    for unit in ("slice", "case", "pixel"):
        assert all(abs(r.dice - 1) < 1e-9 for r in overlap.by_unit(counted, unit, "k").collect())


def test_best_epoch_ignores_nan_and_takes_the_earliest(spark):
    log = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.9), ("a", 3, float("nan"))], "run string, epoch int, iou double")
    assert tuple(ranking.best_epoch(log, "run", "epoch", "iou").first()) == ("a", 2, 0.9)


def test_kfold_covers_patients_evenly(spark):
    rows = spark.createDataFrame([(p, s) for p in range(41) for s in range(3)], "p int, s int")
    out = splits.kfold(rows, "p", 5, 1)
    sizes = [r[0] for r in out.groupBy("fold").agg(F.countDistinct("p")).select("count(DISTINCT p)").collect()]
    assert sum(sizes) == 41 and max(sizes) - min(sizes) <= 1 and out.count() == 123
    assert out.groupBy("p").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    order = np.random.default_rng(1).permutation(41)
    ids = sorted(range(41), key=str)
    assert {(r.p, r.fold) for r in out.collect()} == {(ids[p], k % 5) for k, p in enumerate(order.tolist())}
    for bad in (1, 42):
        with pytest.raises(ValueError):
            splits.kfold(rows, "p", bad, 1)
    with pytest.raises(ValueError, match="without p"):
        splits.kfold(rows.union(spark.createDataFrame([(None, 1)], "p int, s int")), "p", 5, 1)
