"""Class statistics of samples, quality filters with counted rejections, and capped cohorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from lodestar.functions.values import evenly_spaced, ratio
from lodestar.operators.order import free_names, places


@dataclass(frozen=True)
class FilterConfig:
    name: str
    min_classes: int
    threshold: float
    cap: int | None


def parse_filter_config(text: str) -> FilterConfig:
    """name:least classes:threshold:cap; a cap of 0 or less is none."""
    parts = text.split(":")
    if len(parts) != 4 or not parts[0]:
        raise ValueError(f"a filter is name:classes:threshold:cap, not {text!r}")
    cap = int(parts[3])
    return FilterConfig(parts[0], int(parts[1]), float(parts[2]), cap if cap > 0 else None)


def parse_filter_configs(texts: DataFrame, text: str) -> DataFrame:
    """``parse_filter_config`` of a column: (name, min_classes, threshold, cap); one that doesn't fit fails the job."""
    parts = F.split(text, ":")
    wrong = (F.size(parts) != 4) | (parts[0] == "") | F.col(text).isNull()
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("a filter is name:classes:threshold:cap, not "), F.coalesce(text, F.lit("null")))).cast("string")).otherwise(parts[0])
    cap = F.get(parts, F.lit(3)).cast("int")
    return texts.select(checked.alias("name"), F.get(parts, F.lit(1)).cast("int").alias("min_classes"), F.get(parts, F.lit(2)).cast("double").alias("threshold"), F.when(cap > 0, cap).alias("cap"))


def class_stats(pixels: DataFrame, keys: list[str], label: str, classes: list, background: tuple = ()) -> DataFrame:
    """A row for each sample: n_<class>, total, num_classes, and the dominant shares.

    A sample without foreground is dominated wholly.
    """
    counts = [F.sum((F.col(label) == c).cast("bigint")).alias(f"n_{c}") for c in classes]
    return _dominance(pixels.groupBy(*keys).agg(*counts, F.count("*").alias("total")), classes, background)


def _dominance(rows: DataFrame, classes: list, background: tuple) -> DataFrame:
    front = [F.col(f"n_{c}") for c in classes if c not in background]
    largest = F.greatest(*front) if len(front) > 1 else front[0]
    return (
        rows.withColumn("num_classes", sum(((F.col(f"n_{c}") > 0).cast("int") for c in classes), F.lit(0)))
        .withColumn("dominant_foreground", ratio(largest, sum(front[1:], front[0]), 1.0))
        .withColumn("dominant_class", ratio(F.greatest(*(F.col(f"n_{c}") for c in classes)), F.col("total"), 0.0))
    )


def array_stats(rows: DataFrame, keys: list[str], labels: str, classes: int, background: tuple = (0,)) -> DataFrame:
    """``class_stats`` of label arrays, counted inside each row: pixels are never rows. A null array is a sample without pixels."""
    cells = F.coalesce(F.col(labels), F.array().cast("array<int>"))
    of = lambda k: F.size(F.filter(cells, lambda x: x == k)).cast("bigint").alias(f"n_{k}")
    counts = [of(k) for k in range(classes)]
    return _dominance(rows.select(*keys, *counts, F.size(cells).cast("bigint").alias("total")), list(range(classes)), background)


def fractions(stats: DataFrame, classes: list) -> DataFrame:
    return stats.withColumns({f"fraction_{c}": ratio(F.col(f"n_{c}"), F.col("total"), 0.0) for c in classes})


def rejection(min_classes: Column, threshold: Column) -> Column:
    """Why a sample goes: too few classes, and only then imbalance; null if it stays."""
    return F.when(F.col("num_classes") < min_classes, "class_count").when(F.col("dominant_foreground") > threshold, "imbalance")


def filter_samples(stats: DataFrame, group: str, order: str, config: FilterConfig) -> DataFrame:
    """All samples with ``reason`` (null: kept) under one filter, caps spread evenly over each group, and of those that pass, their place and number (``rank``, ``eligible``)."""
    rows = stats.withColumn("reason", rejection(F.lit(config.min_classes), F.lit(config.threshold)))
    rest = rows.where("reason is not null").withColumns({"rank": F.lit(None).cast("bigint"), "eligible": F.lit(None).cast("bigint")})
    passed = places(rows.where("reason is null"), [group], [order]).withColumnsRenamed({"place": "rank", "members": "eligible"})
    kept = evenly_spaced(F.col("rank"), F.col("eligible"), F.lit(config.cap).cast("int"))
    return passed.withColumn("reason", F.when(~kept, "cap")).unionByName(rest)


def filter_audit(stats: DataFrame, group: str, configs: list[FilterConfig]) -> DataFrame:
    """Counts for each filter and group: extracted = removed_class + removed_imbalance + removed_cap + kept.

    An evenly spaced pick keeps as many as its cap, so counts need no ranks.
    """
    spark = stats.sparkSession
    table = spark.createDataFrame([(c.name, c.min_classes, c.threshold, c.cap) for c in configs], "config string, min_classes int, threshold double, cap int")
    rows = stats.crossJoin(F.broadcast(table))  # a handful of configurations
    reason = rejection(F.col("min_classes"), F.col("threshold"))
    n = lambda what: F.sum(what.cast("bigint"))
    found = rows.groupBy("config", group, "cap").agg(
        F.count("*").alias("extracted"),
        *(n(F.coalesce(reason == r, F.lit(False))).alias(name) for r, name in (("class_count", "removed_class"), ("imbalance", "removed_imbalance"))),
        n(reason.isNull()).alias("passed"),
    )
    kept = F.least("passed", F.coalesce("cap", "passed"))
    return found.select("config", group, "extracted", "removed_class", "removed_imbalance", (F.col("passed") - kept).alias("removed_cap"), kept.alias("kept"))


def foreground_fractions(stats: DataFrame, front: list) -> Column:
    """Map of the foreground classes of a sample to their shares of it; empty without foreground."""
    whole = sum((F.col(f"n_{c}") for c in front[1:]), F.col(f"n_{front[0]}"))
    pairs = F.array(*(F.struct(F.lit(str(c)).alias("key"), ratio(F.col(f"n_{c}"), whole, 0.0).alias("value")) for c in front))
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0))


def filter_statistics(samples: DataFrame, broken: DataFrame, group: str) -> DataFrame:
    """One row on a filter's run: all files, broken ones too, what was removed and why, and what was kept, in all and by group.

    ``samples`` as ``filter_samples`` gives them, ``broken`` a row for each file that couldn't be read.
    """
    n = lambda r: F.count(F.when(F.col("reason") == r, 1))
    groups = samples.groupBy(group).agg(F.count("*").alias("rows"), n("class_count").alias("c"), n("imbalance").alias("i"), n("cap").alias("k"), F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"))
    whole = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *(F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("c", "removed_class_count"), ("i", "removed_imbalance"), ("k", "removed_sequence_cap"), ("kept", "kept"))), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kept") > 0, F.struct(group, "kept"))))).alias("kept_by_sequence"))
    bad = broken.agg(F.count("*").alias("corrupt_files"))
    return whole.crossJoin(bad).select((F.col("rows") + F.col("corrupt_files")).alias("before_filtering"), "removed_class_count", "removed_imbalance", "removed_sequence_cap", "corrupt_files", "kept", "kept_by_sequence")


def imbalance_definitions(all_classes: list[Column], front: list[Column]) -> dict[str, Column]:
    """Eight competing tests of balance of a sample's class fractions."""
    top, low = F.greatest(*all_classes), F.least(*all_classes)
    top_front, low_front, total = F.greatest(*front), F.least(*front), sum(front[1:], front[0])
    share = ratio(top_front, total, 1.0)
    return {
        "A": share <= 0.55,
        "A90": share <= 0.90,
        "B": top <= 0.55,
        "C": top_front <= 0.55,
        "D": ratio(low, top, 0.0) >= 0.55,
        "E": ratio(low_front, top_front, 0.0) >= 0.55,
        "F": total <= 0.55,
        "G": ratio(top, low, float("inf")) <= 55.0,
    }


def definition_rollup(rows: DataFrame, group: str, series: str, complete: Column, tests: dict[str, Column], means: list[str]) -> DataFrame:
    """Per group and for ALL: samples, complete ones, kept and kept series per definition, and mean fractions.

    Samples are added up to a row for each group and series first; series are counted there, by whether a definition keeps any of their samples. Rows without a
    series count as samples, not as a series. Without rows there is no result.
    """
    (flag,) = free_names(rows, "complete")
    flagged = rows.withColumn(flag, F.coalesce(complete, F.lit(False)))
    number = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("bigint"))
    parts = {"n": F.count("*"), "complete": number(F.col(flag))}
    parts |= {f"kept_{k}": number(F.col(flag) & t) for k, t in tests.items()}
    of_complete = {c: F.when(F.col(flag), F.col(c)) for c in means}
    parts |= {f"sum_{c}": F.sum(x) for c, x in of_complete.items()} | {f"count_{c}": F.count(x) for c, x in of_complete.items()}
    by_series = flagged.groupBy(F.col(group).alias("g"), F.col(series).alias("s")).agg(*(x.alias(k) for k, x in parts.items()))
    across = by_series.groupBy("s").agg(*(F.sum(k).alias(k) for k in parts))

    def totals(of: GroupedData) -> DataFrame:
        return of.agg(
            F.count("s").alias("series"),
            F.sum("n").alias("total"),
            F.sum("complete").alias("complete"),
            *(F.sum(f"kept_{k}").alias(f"kept_{k}") for k in tests),
            *(F.count(F.when(F.col(f"kept_{k}") > 0, F.col("s"))).alias(f"series_{k}") for k in tests),
            *(F.round(F.sum(f"sum_{c}") / F.nullif(F.sum(f"count_{c}"), F.lit(0)), 4).alias(f"mean_{c}") for c in means),
        )

    whole = totals(across.groupBy()).where("total > 0")
    return totals(by_series.groupBy("g")).unionByName(whole.withColumn("g", F.lit("ALL"))).withColumnRenamed("g", group)
