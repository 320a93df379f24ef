"""Overlap of predicted and true labels by slice, case and pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.values import ratio

SMOOTH = 1e-7


def counts(pixels: DataFrame, keys: list[str], pred: str, true: str, classes: int) -> DataFrame:
    """inter, pred and true pixels for each sample and class, zeros too: one pass, a row a class after it."""
    n = lambda what: F.sum(what.cast("bigint"))
    p, t = F.col(pred), F.col(true)
    wide = pixels.groupBy(*keys).agg(*(F.struct(F.lit(k).alias("class_id"), n((p == k) & (t == k)).alias("inter"), n(p == k).alias("pred"), n(t == k).alias("true")).alias(f"c{k}") for k in range(classes)))
    return wide.select(*keys, F.explode(F.array(*(f"c{k}" for k in range(classes)))).alias("x")).select(*keys, "x.*")


def array_counts(rows: DataFrame, keys: list[str], pred: str, true: str, classes: int) -> DataFrame:
    """``counts`` of label arrays, counted inside each row: pixels are never rows. A null array counts as empty; of arrays of unequal length the longer one's rest has no partner."""
    p, t = F.coalesce(F.col(pred), F.array().cast("array<int>")), F.coalesce(F.col(true), F.array().cast("array<int>"))
    both = F.filter(F.zip_with(p, t, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    n = lambda array, k: F.size(F.filter(array, lambda x: x == k)).cast("bigint")
    rows = rows.select(*keys, both.alias("__b"), p.alias("__p"), t.alias("__t"))
    each = F.array(*(F.struct(F.lit(k).alias("class_id"), n(F.col("__b"), k).alias("inter"), n(F.col("__p"), k).alias("pred"), n(F.col("__t"), k).alias("true")) for k in range(classes)))
    return rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def dice(i: Column, p: Column, t: Column, smooth: float = SMOOTH) -> Column:
    return (2.0 * i + smooth) / (p + t + smooth)


def iou(i: Column, p: Column, t: Column, smooth: float = SMOOTH) -> Column:
    return (i + smooth) / (p + t - i + smooth)


def by_unit(rows: DataFrame, unit: str, case: str) -> DataFrame:
    """dice and iou of each class: means over slices, over cases that pool their slices, or of all pixels pooled."""
    d, j = dice(*map(F.col, ("inter", "pred", "true"))), iou(*map(F.col, ("inter", "pred", "true")))
    if unit == "slice":
        return rows.groupBy("class_id").agg(F.avg(d).alias("dice"), F.avg(j).alias("iou"))
    sums = [F.sum(c).alias(c) for c in ("inter", "pred", "true")]
    pooled = rows.groupBy(*([case] if unit == "case" else []), "class_id").agg(*sums)
    return pooled.groupBy("class_id").agg(F.avg(d).alias("dice"), F.avg(j).alias("iou"))


def headline(metrics: DataFrame, background: bool) -> DataFrame:
    """Means of Dice over the foreground and over all classes, and both means with or without background."""
    front = F.when(F.col("class_id") > 0, F.col("dice"))
    used = F.lit(True) if background else F.col("class_id") > 0
    return metrics.agg(F.avg(front).alias("foreground_macro_dice"), F.avg("dice").alias("all_class_mean_dice"), F.avg(F.when(used, F.col("dice"))).alias("mean_dice"), F.avg(F.when(used, F.col("iou"))).alias("mean_iou"))


def cohort_size(rows: DataFrame, sample: str, case: str) -> DataFrame:
    """Slices and cases that a score rests on."""
    return rows.agg(F.countDistinct(sample).alias("n_slices"), F.countDistinct(case).alias("n_cases"))


def csv_headline(metrics: DataFrame, front: list[str], name: str = "class", score: str = "dice", mean: str = "Mean") -> DataFrame:
    """Of a metric table with named classes: the mean over the ``front`` classes, null if one is missing, and that over all rows but the ``mean`` row."""
    own, several = F.when(F.col(name).isin(front), F.col(score)), F.countDistinct(F.when(F.col(name).isin(front), F.col(name)))
    return metrics.agg(F.when(several == len(front), F.avg(own)).alias("foreground_macro_dice"), F.avg(F.when(F.col(name) != mean, F.col(score))).alias("all_class_mean_dice"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """Pooled, one class against the rest; 0 where undefined."""
    pooled = rows.groupBy("class_id").agg(*(F.sum(c).alias(c) for c in ("inter", "pred", "true")))
    i, p, t = map(F.col, ("inter", "pred", "true"))
    return pooled.select("class_id", ratio(i, p, 0.0).alias("precision"), ratio(i, t, 0.0).alias("recall"), ratio(2 * i, p + t, 0.0).alias("f1"))


def plain_dice(rows: DataFrame, sample: str) -> DataFrame:
    """Mean over all classes of Dice without smoothing, 1 where a class is in neither."""
    return rows.groupBy(sample).agg(F.avg(ratio(2 * F.col("inter"), F.col("pred") + F.col("true"), 1.0)).alias("dice_mean"))


def with_mean_row(metrics: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return metrics.unionByName(metrics.agg(F.lit("Mean").alias(name), *(F.avg(c).alias(c) for c in columns)))
