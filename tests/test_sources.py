import io
import json
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.sources import arrays, tables
from lodestar.streaming import incremental


def save(folder, name, **parts):
    with open(folder / name, "wb") as f:
        np.savez_compressed(f, **parts)


def test_archives_metadata_errors_and_hash(spark, tmp_path):
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    save(tmp_path, "1_t2_s003.npz", image=x, spacing=np.array([0.5, 0.6], np.float32))
    save(tmp_path, "2_t1_s001.npz", image=x, sequence=b"T2_SPACE", series_id="own", slice_index=9)
    save(tmp_path, "3_t1_s001.npz", mask=x)
    (tmp_path / "4_t1_s001.npz").write_bytes(b"junk")
    rows = {r.file[0]: r for r in arrays.read_archives(spark, f"file://{tmp_path}", "image").collect()}
    assert (rows["1"].sequence, rows["1"].series_id, rows["1"].slice_index, rows["1"].shape) == ("T2", "1_t2", 3, [2, 3])
    assert (rows["2"].sequence, rows["2"].series_id, rows["2"].slice_index, rows["2"].spacing) == ("T2_SPACE", "own", 9, [1.0, 1.0])
    assert rows["3"].error == "no array image" and rows["4"].error and rows["4"].cells is None
    other = io.BytesIO()
    np.savez(other, spacing=np.array([0.5, 0.6], np.float32), image=x)
    assert rows["1"].sha256 == arrays.logical_hash(np.load(io.BytesIO(other.getvalue())))
    good = arrays.readable(arrays.read_archives(spark, f"file://{tmp_path}", "image"))
    assert arrays.with_predictions(good, good).where("pred = cells").count() == 2
    with pytest.raises(Exception, match="no prediction"):
        arrays.with_predictions(good, good.where("slice_index = 9")).collect()
    assert arrays.pair_errors(good, good.where("slice_index = 9")).collect()[0].error == "no mask"


def test_discovery_names_files_and_folders_once(spark, tmp_path):
    for name in ("one.parquet", "many.parquet/part-0.parquet", "many.parquet/part-1.parquet", "more.parquet/deep/part-0", "in/one.parquet", "notes.txt", "parquet/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        found = [r.file for r in arrays.found_names(spark, path, "*.parquet").collect()]
        assert sorted(found) == ["many.parquet", "more.parquet", "one.parquet", "one.parquet"]


def test_discovery_of_tables_in_parts_equals_its_sql(spark, tmp_path):
    from lodestar.plans.formats import ORACLE, QUERIES

    want = [file for (file,) in duckdb.sql(ORACLE["directory_discovery"]).fetchall()]
    for name in want:
        (tmp_path / name).mkdir()
        for k in range(2):
            (tmp_path / name / f"part-{k}.parquet").write_bytes(b"x")
    assert sorted(r.file for r in QUERIES["directory_discovery"](spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("packed", [False, True])
def test_volume_slices(spark, tmp_path, packed):
    x = np.arange(24, dtype="<i2").reshape(3, 4, 2)
    x[:, :, 1] = 5
    data = zlib.compress(x.tobytes()) if packed else x.tobytes()
    head = f"NDims = 3\nDimSize = 2 4 3\nElementSpacing = 3 2 1\nElementType = MET_SHORT\nCompressedData = {packed}\nElementDataFile = LOCAL\n"
    (tmp_path / "a.mha").write_bytes(head.encode() + data)
    (tmp_path / "b.mha").write_bytes(b"ElementDataFile = other.raw\n")
    rows = sorted(arrays.read_volume_slices(spark, f"file://{tmp_path}").collect(), key=lambda r: r.file)
    assert len(rows) == 2 and rows[1].error
    assert (rows[0].axis, rows[0].slice_index, rows[0].shape, rows[0].spacing) == (2, 0, [3, 4], [1.0, 2.0])
    assert rows[0].cells == x[:, :, 0].ravel().astype(float).tolist()


def test_lists_metrics_and_configs(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "l.txt").write_text(" b \n\na\n")
    (tmp_path / "twice.txt").write_text("a\na\n")
    assert sorted(r.file for r in tables.read_list(spark, at("l.txt")).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        tables.read_list(spark, at("twice.txt"))
    assert tables.read_list(spark, at("twice.txt"), strict=False).count() == 2
    for k, (a, b) in enumerate([("0.5", "1"), ("NaN", "1"), ("1.01", "1")]):
        (tmp_path / f"m{k}.csv").write_text(f"class,dice\nBackground,0.9\nA,{a}\nB,{b}\nMean,x\n")
    assert {r["class"]: r.dice for r in tables.read_metrics(spark, at("m0.csv"), ["A", "B"]).collect()} == {"A": 0.5, "B": 1.0}
    with pytest.raises(ValueError):
        tables.read_metrics(spark, at("m0.csv"), ["A", "C"])
    for bad in ("m1.csv", "m2.csv"):
        with pytest.raises(Exception, match="not a score"):
            tables.read_metrics(spark, at(bad), ["A", "B"]).collect()
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "config.tsv").write_text("key\tvalue\nsequences\tT2\npreset\t\n")
    row = tables.read_run_configs(spark, at("run")).first()
    assert row.run.endswith("/run") and row.config == {"sequences": "T2", "preset": ""}
    tables.write_list(spark.createDataFrame([("b",), ("a",)], "file string"), at("out"))
    assert [r.file for r in tables.read_list(spark, at("out")).orderBy("file").collect()] == ["a", "b"]
    rows = lambda *r: spark.createDataFrame(r, "k int, x double, s struct<a:array<double>,m:map<string,double>>")
    tables.append_records(rows((1, float("inf"), ([0.5, float("nan")], {"z": float("-inf")}))), at("log"))
    tables.append_records(rows((2, 0.5, None), (3, None, ([], None))), at("log"))
    found = sorted((json.loads(r.value) for r in spark.read.text(at("log")).collect()), key=lambda r: r["k"])
    assert found == [{"k": 1, "x": "inf", "s": {"a": [0.5, "nan"], "m": {"z": "-inf"}}}, {"k": 2, "x": 0.5, "s": None}, {"k": 3, "x": None, "s": {"a": [], "m": None}}]


def test_documents_stay_outside(spark, tmp_path):
    folds = spark.createDataFrame([(1, 0), (2, 1)], "p int, fold int")
    text = tables.fold_json(folds, "p", 7)
    assert json.loads(text) == {"fold_of_patient": {"1": 0, "2": 1}, "kfold_seed": 7, "n_folds": 2}
    tables.save_outside(spark, text, f"file://{tmp_path}/out", f"{tmp_path}/repository")
    assert json.loads(spark.read.text(f"file://{tmp_path}/out", wholetext=True).first().value)["n_folds"] == 2
    with pytest.raises(ValueError, match="lies below"):
        tables.save_outside(spark, text, f"file://{tmp_path}/repository/out", f"file:{tmp_path}/repository")


def test_layers_of_a_configuration(spark, tmp_path, monkeypatch):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"b": 1, "c": 2}}))
    (tmp_path / "child.json").write_text(json.dumps({"extends": "base", "a": {"b": 3}}))
    monkeypatch.setenv("LODESTAR_ROOT", "/x")
    got = tables.layered_config(spark, str(tmp_path), "child", {"root": "/y", "n": 1}, {"LODESTAR_ROOT": "root"}, ["a.c=0.5", "d=plain"])
    assert got == {"a": {"b": 3, "c": 0.5}, "profile": {"root": "/x", "n": 1}, "d": "plain"}
    with pytest.raises(ValueError):
        tables.setting("nothing")


def test_only_new_files_are_processed(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    run = lambda: incremental.process_new(spark, at("in"), "k long", lambda df: df.withColumn("double", F.col("k") * 2), at("out"), at("check"))
    spark.range(3).withColumnRenamed("id", "k").write.parquet(at("in"))
    run()
    spark.range(3, 5).withColumnRenamed("id", "k").write.mode("append").parquet(at("in"))
    run()
    run()
    assert sorted((r.k, r.double) for r in spark.read.parquet(at("out")).collect()) == [(k, 2 * k) for k in range(5)]
