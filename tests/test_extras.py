import numpy as np
import pytest

from lodestar.functions import values
from lodestar.operators import audit, overlap, ranking, splits, surface
from pyspark.sql import functions as F


def test_chosen_samples(spark):
    rows = spark.createDataFrame([(f"f{i:02d}",) for i in range(20)], "file string")
    pick = lambda *a: sorted(r[0] for r in splits.choose(rows, "file", *a).collect())
    assert pick(3, 2, "first") == ["f02", "f03", "f04"]
    assert pick(4, 5, "even") == [f"f{5 + i:02d}" for i in np.linspace(0, 14, 4, dtype=int)]
    assert pick(3, 1, "random", 7) == sorted(f"f{1 + i:02d}" for i in np.random.default_rng(7).choice(19, size=3, replace=False))
    assert len(pick(0, 4, "even")) == len(pick(20, 4, "even")) == 16
    with pytest.raises(ValueError):
        pick(3, 20, "first")
    assert pick(0, 20, "first") == pick(-1, 25, "even") == []  # the rest of the list, which is empty
    with pytest.raises(ValueError):
        splits.choose(rows.limit(0), "file", 0)
    smoke = lambda n: sorted(r[0] for r in splits.smoke_pick(rows, "file", n).collect())
    assert smoke(6) == [f"f{int(i):02d}" for i in np.linspace(0, 19, 6)] and len(smoke(50)) == 20 and smoke(0) == []


def test_draws_by_group(spark):
    # two groups share their names; null is a group
    rows = spark.createDataFrame([(g, f"n{i}") for g in ("x", "y", None) for i in range(4 if g == "x" else 2)], "g string, n string")
    got = {}
    for r in splits.random_cap(rows, "g", "n", 1, 3).collect():
        got.setdefault(r.g, []).append(r.n)
    assert got == {"x": [f"n{np.random.default_rng(3).choice(4, 1, replace=False)[0]}"], "y": [f"n{np.random.default_rng(3).choice(2, 1, replace=False)[0]}"], None: [f"n{np.random.default_rng(3).choice(2, 1, replace=False)[0]}"]}
    parts = {(r.g, r.n): r.part for r in splits.inner_validation(rows, "g", "n", 1, 3).collect()}
    assert len(parts) == 8 and all(sum(p == "val" for (g, _), p in parts.items() if g == k) == 1 for k in ("x", "y", None))
    assert {(g, n) for (g, n), p in parts.items() if p == "val"} == {(g, v[0]) for g, v in got.items()}
    with pytest.raises(ValueError, match="not more than"):
        splits.inner_validation(rows, "g", "n", 2, 3)
    with pytest.raises(ValueError):
        splits.train_subsample(rows, "n", 5, 1)
    assert {r.n for r in splits.train_subsample(rows.where("g = 'x'"), "n", 3, 1).collect()} == {f"n{i}" for i in np.random.default_rng(1).choice(4, 3, replace=False)}


def test_image_split_keeps_sizes_and_the_union(spark):
    rows = spark.createDataFrame([(f"i{i:02d}", "test" if i < 3 else "val" if i < 8 else "train") for i in range(20)], "n string, part string")
    out = {r.n: r.part for r in splits.image_split(rows, "n", "part", 5).collect()}
    order = np.random.default_rng(5).permutation(20)
    assert out == {f"i{i:02d}": "test" if k < 3 else "val" if k < 8 else "train" for k, i in enumerate(order.tolist())}


def test_summary_of_experiments(spark):
    m = [("r1", "A", 0.9, 0.8), ("r1", "B", 0.7, 0.6), ("r1", "Mean", 0.8, 0.7), ("r2", "A", 0.95, 0.8), ("r2", "B", 0.9, 0.6), ("r2", "Mean", 0.92, 0.7), ("r3", "A", 1.0, 1.0), ("r3", "Mean", 1.0, 1.0), ("r4", "A", 1.0, 1.0), ("r4", "B", 1.0, 1.0)]
    metrics = spark.createDataFrame(m, "run string, class string, dice double, iou double")
    log = spark.createDataFrame([("r1", 0, 0.5, 0.4), ("r1", 1, 0.6, 0.3), ("r1", 2, 0.6, 0.9), ("r1", 3, float("nan"), 1.0)], "run string, epoch int, val_mean_iou double, val_dice double")
    configs = spark.createDataFrame([("r1", {"sequences": "T2_SPACE"}), ("r2", {"other": "x"})], "run string, config map<string,string>")
    out = ranking.experiment_summary(metrics, log, configs.where("run = 'r1'"), {"A": 0.9, "B": 0.7}, 0.8, "T2_SPACE")
    got = {r.run: (r.rank, None if r.macro is None else round(r.macro, 6), r.target_met, r.scope_verified, r.best_epoch, r.best_val_dice) for r in out.collect()}
    assert got == {"r2": (1, 0.925, True, False, None, None), "r1": (2, 0.8, True, True, 2, 0.3), "r3": (3, None, False, False, None, None)}
    assert ranking.first_verified(out, "target_met", "scope_verified").first().run == "r1"
    checked = ranking.scope_check(out, configs, "run", "T2_SPACE")
    assert {r.run: (r.stated, r.in_scope) for r in checked.collect()} == {"r1": ("T2_SPACE", True), "r2": (None, False), "r3": (None, False)}


def test_expected_names_and_pairs(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "n string")
    faults = {tuple(r) for r in audit.expected_present(names("a", "b", "c"), names("a", "b", "d"), names("a", "c", "d"), "n").collect()}
    assert faults == {("b", "missing"), ("c", "missing"), ("d", "unexpected")}
    assert audit.expected_present(names("a"), names("a"), names("a"), "n").count() == 0
    assert audit.require_pairs(names("a"), names("a", "b"), names("a"), "n").count() == 1
    for lost in ("b", "z"):
        with pytest.raises(Exception, match=f"no pair for {lost}"):
            audit.require_pairs(names("a", lost), names("a", "b"), names("a"), "n").collect()


def test_headline_of_a_table_lacking_a_class(spark):
    rows = spark.createDataFrame([("A", 0.5), ("Mean", 0.9)], "class string, dice double")
    assert tuple(overlap.csv_headline(rows, ["A"]).first()) == (0.5, 0.5) and overlap.csv_headline(rows, ["A", "B"]).first().foreground_macro_dice is None


def test_signed_ranks_by_all_signs(spark):
    assert ranking.signed_rank_p(np.arange(1.0, 11)) == (0.0, 2 / 1024)
    d = np.array([0.0, 1, -1, 2, 3, -4, 2, 7])
    x = d[d != 0]
    r = np.array([(np.abs(x) < a).sum() + ((np.abs(x) == a).sum() + 1) / 2 for a in np.abs(x)])
    least = min(r[x > 0].sum(), r[x < 0].sum())
    sums = [r[[bool(m >> i & 1) for i in range(len(r))]].sum() for m in range(1 << len(r))]
    assert ranking.signed_rank_p(d) == (least, min(1.0, 2 * np.mean(np.array(sums) <= least)))
    pairs = spark.createDataFrame([("x", 2.0, 1.0), ("x", 3.0, 1.0), ("y", 1.0, None), ("y", 1.0, 1.0)], "g string, a double, b double")
    assert {tuple(r) for r in ranking.signed_rank(pairs, "g", "a", "b").collect()} == {("x", 2, 1.5, 0.0, 0.5), ("y", 1, 0.0, 0.0, 1.0)}


def test_bands_and_sizes(spark):
    rng = np.random.default_rng(1)
    m = rng.random((7, 9)) < 0.1
    band = surface.boundary_band(m, 3)
    for r in range(7):
        for c in range(9):
            near = m[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2]
            assert band[r, c] == (near.any() and not near.all())
    ramp = np.add.outer(np.arange(4.0), np.arange(6.0))
    assert np.allclose(surface.resized(ramp, (4, 6), False), ramp) and np.array_equal(surface.resized(ramp, (8, 12), True)[::2, ::2], ramp)
    assert np.allclose(surface.resized(ramp, (2, 3), False), [[1, 3, 5], [3, 5, 7]])
    rows = spark.createDataFrame([(1, 1, 2, [0.0, 1.0]), (2, 1, 2, None)], "id int, h int, w int, x array<double>")
    assert [tuple(r) for r in surface.resize_images(rows, "id", "x", "h", "w", (1, 4)).orderBy("id").collect()] == [(1, 1, 4, [0.0, 0.25, 0.75, 1.0]), (2, None, None, None)]


def test_ensemble(spark):
    row = spark.range(1).select(values.argmax(values.ensemble([F.array(F.lit(0.6), F.lit(0.4)), F.array(F.lit(0.1), F.lit(0.9))])))
    assert row.first()[0] == 1
