"""Tables read by their own headers, rows in file order, and the searches over images against plain ones."""

import numpy as np
import pytest

from lodestar.operators import audit, cohort, surface
from lodestar.operators.order import places
from lodestar.sources import tables


def save(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return f"file://{folder}"


def test_each_table_has_its_own_header(spark, tmp_path):
    path = save(
        tmp_path,
        {
            "a/validation_metrics.csv": "class,iou,dice\nIVDs,0.8,0.9\nMean,inf,0.5\n\nMean,0.4,0.6\n",
            "b/validation_metrics.csv": 'class,dice,iou\n"IVDs",0.7,0.6\n',
            "c/validation_metrics.csv": "asd,class,dice,dice\n1.5,IVDs,0.1,0.2\n,Mean\n",
            "d/validation_metrics.csv": "class,dice\n",
            "a/other.csv": "x\n1\n",
        },
    )
    got = {(r["run"].rsplit("/", 1)[1], r["class"]): (r["dice"], r["iou"], r["asd"]) for r in tables.read_metric_files(spark, path).collect()}
    assert got == {("a", "IVDs"): (0.9, 0.8, None), ("a", "Mean"): (0.6, 0.4, None), ("b", "IVDs"): (0.7, 0.6, None), ("c", "IVDs"): (0.2, None, 1.5), ("c", "Mean"): (None, None, None)}


def test_logs_without_a_column_and_names_by_case(spark, tmp_path):
    path = save(tmp_path / "logs", {"a/training_log.csv": "epoch,loss,val_mean_iou\n0,1.5,0.2\n", "b/training_log.csv": "epoch,accuracy,loss,val_mean_iou\n0,0.9,1,nan\n"})
    got = sorted(tuple(map(str, r[1:])) for r in tables.read_training_log(spark, path).select("run", "epoch", "accuracy", "loss", "val_mean_iou").collect())
    assert got == [("0.0", "0.9", "1.0", "nan"), ("0.0", "None", "1.5", "0.2")]
    with pytest.raises(ValueError, match="case"):
        tables.read_by_header(spark, save(tmp_path / "case", {"a.csv": "Dice\n1\n", "b.csv": "dice\n1\n"}))


def test_rows_are_in_file_order(spark, tmp_path):
    files = {"part-0.csv": "new_file_name,subset\nx,training\n", "part-1.csv": "new_file_name,subset\n" + "".join(f"n{i},validation\n" for i in range(300))}
    rows = sorted((r.position, r.new_file_name) for r in tables.read_overview(spark, save(tmp_path, files)).collect())
    assert rows == list(enumerate(["x", *(f"n{i}" for i in range(300))]))


def test_manifests_are_compared_place_by_place(spark):
    frame = lambda rows: spark.createDataFrame(rows, "file string, position long")
    a, b = frame([("x", 0), ("y", 1), ("z", 2)]), frame([("y", 0), ("x", 1), ("z", 2)])
    assert sorted(map(tuple, audit.manifest_diff(a, b).collect())) == [("x", 0, "ours"), ("x", 1, "theirs"), ("y", 0, "theirs"), ("y", 1, "ours")]
    assert audit.manifest_diff(a, a).isEmpty() and audit.manifest_diff(a, b, ordered=False).isEmpty()
    with pytest.raises(ValueError, match="position"):
        audit.manifest_diff(a.drop("position"), b)


def test_lists_are_stripped_of_all_blanks(spark, tmp_path):
    path = save(tmp_path, {"list.txt": "a.npz\n \t\nb.npz\t\n c.npz \n"})
    assert sorted(r.file for r in tables.read_list(spark, path).collect()) == ["a.npz", "b.npz", "c.npz"]
    with pytest.raises(ValueError, match="twice"):
        tables.read_list(spark, save(tmp_path / "2", {"list.txt": "a.npz\na.npz\t\n"}))


def test_places_with_clashing_columns(spark):
    rows = spark.createDataFrame([(i % 2 or None, -i, "own", i) for i in range(20)], "group int, n int, place string, range int")
    got = places(rows, ["group"], ["n"]).collect()
    for group in (None, 1):
        mine = sorted((r for r in got if r.group == group), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(10)) and [r.n for r in mine] == sorted(r.n for r in mine) and {r.members for r in mine} == {10}
    assert got[0].asDict().keys() == {"group", "n", "range", "place", "members"}


def test_filter_configs(spark):
    texts = spark.createDataFrame([("strict:3:0.55:500",), ("loose:2:0.9:0",)], "text string")
    want = [cohort.parse_filter_config(r.text) for r in texts.collect()]
    assert sorted(map(tuple, cohort.parse_filter_configs(texts, "text").collect())) == sorted((c.name, c.min_classes, c.threshold, c.cap) for c in want)
    for wrong in ("a:1:2", ":1:0.5:3", None):
        with pytest.raises(Exception, match="a filter is"):
            cohort.parse_filter_configs(spark.createDataFrame([(wrong,)], "text string"), "text").collect()


@pytest.mark.parametrize("seed", range(6))
def test_distances_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        shape = tuple(rng.integers(1, 14, 2))
        points, spacing = rng.random(shape) < rng.choice([0, 0.03, 0.3, 1]), tuple(rng.uniform(0.1, 5, 2))
        got, at = surface.squared_distances(points, spacing), np.argwhere(points)
        for r, c in np.ndindex(shape):
            want = min((((r - y) * spacing[0]) ** 2 + ((c - x) * spacing[1]) ** 2 for y, x in at), default=np.inf)
            assert got[r, c] == want or abs(got[r, c] - want) < 1e-9 * want


@pytest.mark.parametrize("size", range(1, 16))
def test_windows_equal_plain_ones(size):
    rng = np.random.default_rng(size)
    for _ in range(10):
        x = rng.random(tuple(rng.integers(1, 20, 2))) < 0.1
        before = (size - 1) // 2
        wide = np.pad(x, ((before, size - 1 - before),) * 2)
        want = np.array([[wide[r : r + size, c : c + size].any() for c in range(x.shape[1])] for r in range(x.shape[0])])
        assert (surface.near_any(x, size, before) == want).all()
        eroded = np.array([[np.pad(x, 1)[r : r + 3, c : c + 3].all() for c in range(x.shape[1])] for r in range(x.shape[0])])
        assert (surface.erode(x) == eroded).all()
