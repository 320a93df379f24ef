"""Lists, metric tables, logs and configurations as DataFrames, and their writers."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.values import json_text, optional_float, strict_score
from lodestar.operators.order import places
from lodestar.sources.scratch import written


def _ensure(df: DataFrame, wrong: DataFrame, what: str) -> DataFrame:
    """``df``, or an error that shows a few of the ``wrong`` rows."""
    if bad := wrong.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")
    return df


#: Fixed value: what is stripped from both ends of a line, all that Unicode calls white space and the four separators of ASCII.
_BLANK = r"(?U)[\s\x1C-\x1F]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}", ""), f"{_BLANK}$", "")


def file_order() -> Column:
    """Where a row stands in its files: path, start of the block, and a number that grows within a block. A block is read by one task, whatever else that reads."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file): stripped lines that aren't blank. ``strict``: none at all, and one that occurs twice, are errors."""
    rows = spark.read.text(path).select(stripped(F.col("value")).alias("file")).where("file <> ''")
    if not strict:
        return rows
    if rows.isEmpty():
        raise ValueError(f"{path} lists no files")
    return _ensure(rows, rows.groupBy("file").count().where("count > 1"), f"{path} lists a file twice")


def plain_names(rows: DataFrame, key: str = "file") -> DataFrame:
    return _ensure(rows, rows.where(F.col(key).contains("/")).select(key), "names with folders")


def read_overview(spark: SparkSession, path: str, name: str = "new_file_name", subset: str = "subset") -> DataFrame:
    """(name, subset, position) as text; ``position`` counts the rows from 0 in the order of the files' paths and of the rows in each."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    rows = rows.select(F.col(name).cast("string").alias(name), F.col(subset).alias(subset), file_order().alias("at"))
    return places(rows, [], ["at"], "position").select(name, subset, "position")


def read_metrics(spark: SparkSession, path: str, wanted: list[str], score: str = "dice") -> DataFrame:
    """(class, score) of the wanted classes; a class that is missing or double, and a score that isn't a number from 0 to 1, are errors."""
    rows = spark.read.option("header", True).csv(path).where(F.col("class").isin(wanted)).select("class", score)
    _ensure(rows, rows.groupBy("class").count().where("count > 1"), "classes that occur twice")
    there = rows.groupBy().agg(F.collect_set("class").alias("c"))  # at most the wanted classes
    lost = there.select(F.explode(F.array_except(F.array(*map(F.lit, wanted)), "c")))
    _ensure(rows, lost, "classes that are missing")
    return rows.select("class", strict_score(F.col(score)).alias(score))


def run_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


#: Different column names that all tables below a folder may have.
MAX_NAMES = 10_000


def read_by_header(spark: SparkSession, path: str, pattern: str | None = None, sep: str = ",") -> DataFrame:
    """Rows of delimited files, each read by its own header line: (run, at, and a text column for each name that any file has).

    A column that a file lacks is null in its rows; of a name that a header has twice the last one counts; fields beyond the header are left out. Rows
    are single lines; blank lines aren't rows. ``at`` is a row's ``file_order``. More than ``MAX_NAMES`` names, or names that differ by case alone, are an error.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path).select("value", file_order().alias("at"))
    lines = written(lines.where(F.trim("value") != ""), "lines")  # places in files are kept, not found a second time
    first = lines.groupBy(F.col("at.path").alias("path")).agg(F.min(F.struct("at", "value")).alias("first")).select("path", F.col("first.at").alias("first"), F.col("first.value").alias("header"))
    width = first.agg(F.max(F.size(F.split("header", F.lit(f"\\Q{sep}\\E")))).alias("n")).first()["n"] or 1
    cells = lambda c: F.array(*(F.from_csv(c, ", ".join(f"c{i} string" for i in range(width)), {"sep": sep})[f"c{i}"] for i in range(width)))
    headers = first.select("path", "first", cells(F.col("header")).alias("names"))
    found = [r[0] for r in headers.select(F.explode("names").alias("name")).where("name is not null").distinct().limit(MAX_NAMES + 1).collect()]
    if len(found) > MAX_NAMES or len({c.lower() for c in found}) < len(found):
        raise ValueError(f"{path}: more than {MAX_NAMES} column names, or some that differ by case alone")
    rows = lines.join(headers, F.col("at.path") == F.col("path")).where(F.col("at") != F.col("first"))
    rows = rows.select(run_folder(F.col("path")).alias("run"), "at", F.arrays_zip("names", cells(F.col("value")).alias("values")).alias("cells"))
    of = lambda name: F.try_element_at(F.filter("cells", lambda x: x["names"] == name), F.lit(-1))["values"].alias(name)
    return rows.select("run", "at", *(of(c) for c in sorted(found) if c.lower() not in ("run", "at")))


def read_metric_files(spark: SparkSession, path: str, pattern: str = "validation_metrics.csv") -> DataFrame:
    """Rows of all metric tables below ``path`` with their ``run`` folder, each table by its own header; blank and infinite numbers are null, as are columns that a table lacks. Of a class that occurs twice the last row counts."""
    rows = read_by_header(spark, path, pattern)
    numbers = [c for c in rows.columns if c not in ("run", "class", "at")]
    return rows.groupBy("run", "class").agg(*(F.max_by(optional_float(F.col(c)), "at").alias(c) for c in numbers))


def read_training_log(spark: SparkSession, path: str, pattern: str = "training_log.csv") -> DataFrame:
    """Rows of all logs below ``path`` with their ``run`` folder, each log by its own header; what isn't a number is null, as are columns that a log lacks."""
    rows = read_by_header(spark, path, pattern)
    return rows.select("run", *(F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns if c not in ("run", "at")))


def read_run_configs(spark: SparkSession, path: str, strict: bool = True, pattern: str = "*.tsv") -> DataFrame:
    """(run, config map): key and value tables; ``strict``: blank and double keys are errors, else the last value counts."""
    rows = spark.read.schema("key string, value string").option("header", True).option("sep", "\t").option("enforceSchema", False).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)
    rows = rows.select(run_folder(F.col("_metadata.file_path")).alias("run"), F.trim(F.coalesce("key", F.lit(""))).alias("key"), F.coalesce("value", F.lit("")).alias("value"), file_order().alias("at"))
    if strict:
        _ensure(rows, rows.groupBy("run", "key").count().where("count > 1 or key = ''"), "keys that are blank or occur twice")
    last = rows.where("key <> ''").groupBy("run", "key").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("config"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, image_sha256, mask_sha256, position), the first three of which have to be the header; ``position`` counts from 0 in file order. No row is an error."""
    rows = spark.read.schema("file string, image_sha256 string, mask_sha256 string").option("header", True).option("sep", "\t").option("enforceSchema", False).option("recursiveFileLookup", True).csv(path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return places(rows.withColumn("at", file_order()), [], ["at"], "position").select("file", "image_sha256", "mask_sha256", "position")


# -- writers -------------------------------------------------------------------------------


def write_list(rows: DataFrame, path: str, key: str = "file", order: str | None = None) -> None:
    """Names in order as text; a range exchange, so that part files follow each other."""
    rows.orderBy(order or key).select(F.col(key).cast("string")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def append_records(rows: DataFrame, path: str) -> None:
    """One JSON object a row, appended; numbers that aren't finite are words, at any depth, and all others stay numbers."""
    rows.select(json_text(rows.schema).alias("value")).write.mode("append").text(path)


_RECORDS = "record string"


def _recorded(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], _RECORDS).write.mode("ignore").parquet(f"{path}/_log")  # so that it can be read before any append
    return spark.read.schema(_RECORDS).parquet(f"{path}/_log").distinct()


def append_once(rows: DataFrame, path: str, record: str) -> bool:
    """``append_records`` under a name; False if that name was appended before. What broke off before it was logged isn't read, and is written anew over its remains. One writer at a time."""
    spark = rows.sparkSession
    if not record or any(c in record for c in "/=%"):
        raise ValueError("a record's name is text without / = %")
    if not _recorded(spark, path).where(F.col("record") == record).isEmpty():
        return False
    rows.select(json_text(rows.schema).alias("value")).write.mode("overwrite").text(f"{path}/record={record}")
    spark.createDataFrame([(record,)], _RECORDS).coalesce(1).write.mode("append").parquet(f"{path}/_log")
    return True


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, value) of what ``append_once`` has logged; ``value`` is a JSON object."""
    logged = _recorded(spark, path)
    if logged.isEmpty():
        return spark.createDataFrame([], "record string, value string")
    found = spark.read.option("recursiveFileLookup", True).text(path)
    found = found.select(F.regexp_extract("_metadata.file_path", r"/record=([^/]*)/[^/]*$", 1).alias("of_file"), "value")
    decoded = found.withColumn("of_file", F.url_decode(F.replace("of_file", F.lit("+"), F.lit("%2B"))))
    return logged.join(decoded, F.col("record") == F.col("of_file")).select("record", "value")


def _few(rows: DataFrame, most: int) -> list:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one report")
    return found


def _cell(x: object) -> str:
    return "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def _table(head: list[str], rows: list[list]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *([_cell(x) for x in row] for row in rows)])


def ranking_report(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A Markdown table of ranked runs, in the order given; a report of more than ``most`` rows is an error."""
    return _table(columns, [list(r) for r in _few(rows.select(*columns), most)])


def count_report(counts: DataFrame, group: str, order: list[str], tests: list[str], most: int = 1000) -> str:
    """A Markdown table with a column for each group in ``order`` and a line for series, samples, complete ones, and each test's kept samples (and series).

    ``counts`` has the columns group, series, total, complete, and kept_<test> and series_<test> of each test.
    """
    found = {r[group]: r for r in _few(counts, most)}
    cell = lambda g, f: f(found[g]) if g in found else 0
    lines = [[name, *(cell(g, lambda r, name=name: r[name]) for g in order)] for name in ("series", "total", "complete")]
    lines += [[t, *(cell(g, lambda r, t=t: f"{r[f'kept_{t}']} ({r[f'series_{t}']})") for g in order)] for t in tests]
    return _table(["", *order], lines)


def count_json(counts: DataFrame, group: str, errors: DataFrame, definitions: dict[str, str], most: int = 1000) -> str:
    """The counts of each group, the definitions' texts and the errors, as one JSON document."""
    summary = {r[0]: json.loads(r[1]) for r in _few(counts.select(group, json_text(counts.drop(group).schema)), most)}
    return json.dumps({"definitions": definitions, "errors": sorted(r[0] for r in _few(errors, most)), "summary": summary}, sort_keys=True, indent=1, ensure_ascii=False)


def fold_json(folds: DataFrame, patient: str, seed: int, most: int = 1_000_000) -> str:
    """Which fold each patient is in, as one JSON document; it names patients, so it belongs outside of any repository."""
    of = {str(r[0]): r[1] for r in _few(folds.select(patient, "fold").distinct(), most)}
    return json.dumps({"fold_of_patient": of, "kfold_seed": seed, "n_folds": len(set(of.values()))}, sort_keys=True, indent=1)


def save_document(spark: SparkSession, text: str, path: str) -> None:
    """One text as one file below ``path``."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_outside(spark: SparkSession, text: str, path: str, forbidden: str) -> None:
    """``save_document``, but never below the folder ``forbidden``."""
    plain = lambda p: os.path.abspath(p.removeprefix("file://").removeprefix("file:"))
    if os.path.commonpath([plain(path), plain(forbidden)]) == plain(forbidden):
        raise ValueError(f"{path} lies below {forbidden}")
    save_document(spark, text, path)


# -- configurations ------------------------------------------------------------------------


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with the values of ``over``; mappings in both are merged in turn."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}}


def setting(text: str) -> dict:
    """``a.b=value`` as nested mappings; the value is JSON where it parses, else text."""
    name, equals, raw = text.partition("=")
    if not equals or not name:
        raise ValueError(f"a setting is a.b=value, not {text!r}")
    try:
        value = json.loads(raw)
    except json.JSONDecodeError:
        value = raw
    for part in reversed(name.split(".")):
        value = {part: value}
    return value


def layered_config(spark: SparkSession, folder: str, name: str, profile: Mapping | None = None, env: Mapping[str, str] | None = None, sets: list[str] = ()) -> dict:
    """A JSON configuration over those it ``extends``, under a profile, environment variables (variable -> profile key) and settings. Files are read by Spark, wherever they are."""
    layers, seen = [], set()
    while name:
        if name in seen:
            raise ValueError(f"{name} extends itself")
        seen.add(name)
        layers.append(json.loads(spark.read.option("wholetext", True).text(f"{folder}/{name}.json").first()["value"]))
        name = layers[-1].pop("extends", None)
    over = [{"profile": dict(profile or {})}, {"profile": {key: os.environ[v] for v, key in (env or {}).items() if os.environ.get(v)}}, *map(setting, sets)]
    out: dict = {}
    for layer in (*reversed(layers), *over):
        out = merged(out, layer)
    return out
