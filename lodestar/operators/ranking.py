"""Ranked samples, best epochs, experiments and target decisions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.order import places


def rank_rows(rows: DataFrame, metric: str, name: str, k: int, descending: bool = False) -> DataFrame:
    """The first ``k`` by metric and name; ``descending`` reverses both; 0: all."""
    order = [F.col(metric).desc(), F.col(name).desc()] if descending else [F.col(metric), F.col(name)]
    out = rows.orderBy(*order)
    return out.limit(k) if k > 0 else out


def worst_per_metric(rows: DataFrame, metrics: list[str], name: str, k: int) -> DataFrame:
    """The ``k`` least rows of each metric with their ranks from 1."""
    each = rows.select(name, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(name, "x.*")
    by = Window.partitionBy("metric").orderBy("value", name)  # a top-k: tasks drop all but k rows before the shuffle
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def best_epoch(log: DataFrame, run: str, epoch: str, metric: str, carry: str | None = None) -> DataFrame:
    """The earliest epoch (from 1) with the greatest metric, and that epoch's ``carry``; NaN never wins."""
    rows = log.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    best = rows.groupBy(run).agg(F.max(F.struct(F.col(metric), (-F.col(epoch)).alias("e"), *([carry] if carry else []))).alias("b"))
    return best.select(run, (1 - F.col("b.e")).alias("best_epoch"), F.col(f"b.{metric}").alias("best"), *([F.col(f"b.{carry}")] if carry else []))


def target_decision(metrics: DataFrame, run: str, name: str, score: str, floors: dict[str, float], macro: float) -> DataFrame:
    """Whether the mean over the named classes reaches ``macro`` and every class its floor; a run without one of them fails."""
    floor = F.create_map(*(F.lit(x) for pair in floors.items() for x in pair))
    rows = metrics.where(F.col(name).isin(*floors))
    out = rows.groupBy(run).agg(F.avg(score).alias("macro"), F.bool_and(F.col(score) >= F.element_at(floor, F.col(name))).alias("floors_met"), F.countDistinct(name).alias("classes"))
    return out.withColumn("passed", F.col("floors_met") & (F.col("macro") >= macro) & (F.col("classes") == len(floors)))


def experiment_rank(runs: DataFrame, score: str, path: str) -> DataFrame:
    """Runs with their ``rank``: the greatest score first, runs without one last, ties by path."""
    return places(runs, [], [F.col(score).desc_nulls_last(), F.col(path)]).select(*runs.columns, (F.col("place") + 1).cast("int").alias("rank"))


def first_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of a list by its position; all if ``n`` is 0."""
    return rows.orderBy(order).limit(n) if n > 0 else rows


def first_verified(ranked: DataFrame, met: str, verified: str) -> DataFrame:
    """The best ranked run that meets its target within the verified scope, if any."""
    return ranked.where(F.col(met) & F.col(verified)).orderBy("rank").limit(1)


def experiment_summary(metrics: DataFrame, log: DataFrame, configs: DataFrame, floors: dict[str, float], macro: float, scope: str, mean: str = "Mean") -> DataFrame:
    """A row for each run that has a ``mean`` row, ranked by the macro mean over the classes of ``floors``.

    ``metrics``: run, class, dice, iou; ``log``: run, epoch from 0, val_mean_iou, val_dice; ``configs``: run, config map. A run without a score of
    each class has no macro mean and doesn't meet the target; runs without log or configuration have nulls, and a scope that isn't verified.
    """
    of = lambda name, column="dice": F.max(F.when(F.col("class") == name, F.col(column)))
    wide = metrics.groupBy("run").agg(F.bool_or(F.col("class") == mean).alias("has_mean"), of(mean).alias("mean_dice"), of(mean, "iou").alias("mean_iou"), *(of(c).alias(f"dice_{i}") for i, c in enumerate(floors))).where("has_mean")
    scores = [F.col(f"dice_{i}") for i in range(len(floors))]
    total = sum(scores[1:], scores[0]) / len(scores)  # null if one is
    passed = F.lit(True)
    for x, floor in zip(scores, floors.values(), strict=True):
        passed = passed & (x >= floor)
    best = best_epoch(log, "run", "epoch", "val_mean_iou", carry="val_dice")
    out = wide.join(best, "run", "left").join(configs, "run", "left")
    out = out.select(
        "run", "mean_dice", "mean_iou", *(f"dice_{i}" for i in range(len(floors))), total.alias("macro"), F.coalesce(passed & (total >= macro), F.lit(False)).alias("target_met"),
        F.coalesce(F.element_at("config", F.lit("sequences")) == scope, F.lit(False)).alias("scope_verified"), "best_epoch", F.col("best").alias("best_val_mean_iou"), F.col("val_dice").alias("best_val_dice"),
    )
    return experiment_rank(out, "macro", "run")


def scope_check(decisions: DataFrame, configs: DataFrame, run: str, required: str, key: str = "sequences") -> DataFrame:
    """Target decisions with what the run's manifest states under ``key`` and whether that is the ``required`` scope."""
    stated = configs.select(run, F.try_element_at("config", F.lit(key)).alias("stated"))
    return decisions.join(stated, run, "left").withColumn("in_scope", F.coalesce(F.col("stated") == required, F.lit(False)))


def run_summary(runs: DataFrame, condition: str, score: str) -> DataFrame:
    """Runs, mean and sample deviation of each condition; the deviation of a single run is null."""
    return runs.groupBy(condition).agg(F.count(score).alias("runs"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"))


#: Up to so many pairs that differ the distribution of the rank sum is counted out, beyond it the normal one is taken.
EXACT_PAIRS = 50


def two_sided_p(least: int, total: int, squares: float, ranks: list[int]) -> float:
    """The two-sided p of the smaller of two sums of signed ranks. All are doubled, so that shared ranks are whole: the sum, that of all ranks, and of their squares; ``ranks`` if there are few."""
    if not total:
        return 1.0
    if not ranks:
        return min(1.0, math.erfc((total / 2 - least) / math.sqrt(squares / 2)))
    ways = np.zeros(total + 1)
    ways[0] = 1.0
    for r in ranks:
        ways[r:] += ways[:-r].copy()
    return min(1.0, 2 * ways[: least + 1].sum() / 2.0 ** len(ranks))


def signed_rank_p(differences: np.ndarray) -> tuple[float, float]:
    """The smaller sum of signed ranks of an array, and the two-sided p; zeros are left out, ties share their mean rank."""
    d = differences[differences != 0]
    twice = (pd.Series(np.abs(d)).rank() * 2).astype(int).to_numpy()
    least = int(min(twice[d > 0].sum(), twice[d < 0].sum())) if len(d) else 0
    return least / 2, two_sided_p(least, int(twice.sum()), float((twice.astype(float) ** 2).sum()), twice.tolist() if len(d) <= EXACT_PAIRS else [])


def signed_rank(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, pairs, mean_difference, statistic, p) of a - b, one row a comparison; pairs without a difference count, but have no rank, and equal ones share their mean rank.

    Ranks come from places in sorted ranges and sums over runs of equal values, so a comparison of any number of pairs is in no task; up to ``EXACT_PAIRS`` ranks meet in a row.
    """
    rows = pairs.select(F.col(group).alias("g"), (F.col(a) - F.col(b)).cast("double").alias("d")).where(F.col("d").isNotNull() & ~F.isnan("d"))
    whole = rows.groupBy("g").agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_difference"))
    placed = places(rows.where("d <> 0").select("g", F.abs("d").alias("size"), (F.col("d") > 0).alias("more")), ["g"], ["size"])
    runs = placed.groupBy("g", "size").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum(F.col("more").cast("bigint")).alias("up"), F.max("members").alias("members"))
    runs = runs.withColumn("twice", F.col("first") * 2 + F.col("n") + 1)
    few = F.when(F.col("members") <= EXACT_PAIRS, F.array_repeat("twice", F.col("n").cast("int")))
    sums = runs.groupBy(F.col("g").alias("of")).agg(
        F.sum(F.col("twice") * F.col("up")).alias("up"),
        F.sum(F.col("twice") * F.col("n")).alias("total"),
        F.sum(F.col("twice").cast("double") ** 2 * F.col("n")).alias("squares"),
        F.flatten(F.collect_list(few)).alias("ranks"),
    )
    joined = whole.join(sums, F.col("g").eqNullSafe(F.col("of")), "left")
    kind = pairs.schema[group].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = [two_sided_p(int(least), int(total), squares, [] if ranks is None else [int(r) for r in ranks]) for least, total, squares, ranks in zip(f["least"], f["total"], f["squares"], f["ranks"], strict=True)]
            yield f[["g", "pairs", "mean_difference"]].assign(statistic=f["least"] / 2, p=p)

    up, total = F.coalesce("up", F.lit(0)), F.coalesce("total", F.lit(0))
    rows = joined.select("g", "pairs", "mean_difference", F.least(up, total - up).alias("least"), total.alias("total"), F.coalesce("squares", F.lit(0.0)).alias("squares"), "ranks")
    return rows.mapInPandas(run, f"g {kind}, pairs bigint, mean_difference double, statistic double, p double").withColumnRenamed("g", group)
