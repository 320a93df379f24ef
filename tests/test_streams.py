"""Digests that are streamed, records that count once, series that are counted by one row each."""

import hashlib

from pyspark.sql import functions as F

from lodestar.operators import audit, cohort
from lodestar.sources import tables


def test_fingerprints_of_groups(spark):
    rows = [(g, n, "x") for g, n in [("a", "z"), ("a", "b"), ("a", "b"), ("a", None), (None, "n"), ("only nulls", None), ("", ""), ("", ""), *(("big", f"n{i:05d}") for i in range(25_000))]]
    got = {r[0]: (r.n, r.sha256) for r in audit.cohort_fingerprint(spark.createDataFrame(rows, "grp string, n string, g string").repartition(5), "grp", "n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        want[g] = (sum(r[0] == g for r in rows), hashlib.sha256("\n".join(own).encode()).hexdigest())
    assert got == want
    assert audit.cohort_fingerprint(spark.createDataFrame([], "g int, name string"), "g", "name").isEmpty()


def test_records_count_once(spark, tmp_path):
    path, rows = f"file://{tmp_path}/log", spark.createDataFrame([(1, float("nan"))], "run int, score double")
    assert tables.read_records(spark, path).isEmpty()
    assert tables.append_once(rows, path, "a b+c") and not tables.append_once(rows, path, "a b+c")
    rows.select(F.lit("broken off").alias("value")).write.text(f"{path}/record=later")  # never logged
    assert [tuple(r) for r in tables.read_records(spark, path).collect()] == [("a b+c", '{"run":1,"score":"nan"}')]
    assert tables.append_once(rows.where("run > 1"), path, "none") and tables.append_once(rows, path, "later")
    assert sorted(r.record for r in tables.read_records(spark, path).collect()) == ["a b+c", "later"]


def test_series_are_counted_without_expanding_samples(spark):
    rows = spark.createDataFrame([("g", "s", 0.5, True), ("g", "s", 0.9, True), ("g", "t", 0.9, False), ("h", "s", 0.1, True), ("h", None, 0.2, True), (None, "u", 0.3, None)], "g string, complete string, f double, ok boolean")
    out = cohort.definition_rollup(rows, "g", "complete", F.col("ok"), {"A": F.col("f") <= 0.5}, ["f"])
    got = {r.g: tuple(r)[1:] for r in out.collect()}
    assert got == {"g": (2, 3, 2, 1, 1, 0.7), "h": (1, 2, 2, 2, 1, 0.15), None: (1, 1, 0, 0, 0, None), "ALL": (3, 6, 4, 3, 1, 0.425)}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert cohort.definition_rollup(rows.limit(0), "g", "complete", F.col("ok"), {}, ["f"]).isEmpty()
