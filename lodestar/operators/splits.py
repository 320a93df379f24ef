"""Divisions of samples into training, validation and test parts."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.values import evenly_spaced
from lodestar.operators.cohort import FilterConfig, filter_audit, filter_samples
from lodestar.operators.order import places
from lodestar.sources.scratch import written


def split_parts(samples: DataFrame, key: str, overview: DataFrame, name: str, subset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and unmatched samples; an id that the overview has in both subsets is in both."""
    of = lambda what: overview.where(F.col(subset) == what).select(F.col(name).alias(key))
    train, validation = samples.join(of("training"), key, "left_semi"), samples.join(of("validation"), key, "left_semi")
    return train, validation, samples.join(of("training").union(of("validation")), key, "left_anti")


def chosen_split(samples: DataFrame, key: str, overview: DataFrame, name: str, subset: str, which: str, strict: bool = False) -> DataFrame:
    """``which``: train, validation or all. ``strict``: unmatched samples are an error."""
    train, validation, unmatched = split_parts(samples, key, overview, name, subset)
    if strict and (lost := unmatched.limit(5).collect()):
        raise ValueError(f"samples in neither subset: {[r[key] for r in lost]}")
    return {"train": train, "validation": validation, "all": samples}[which]


def with_subset(samples: DataFrame, key: str, overview: DataFrame, name: str, subset: str, position: str) -> DataFrame:
    """``subset`` of each sample by the overview's first row of its id, else "unmatched"."""
    first = overview.groupBy(F.col(name).alias(key)).agg(F.min_by(subset, position).alias("subset"))
    return samples.join(first, key, "left").withColumn("subset", F.coalesce("subset", F.lit("unmatched")))


def selected_by_series(volumes: DataFrame, series: str, wanted: DataFrame, name: str) -> DataFrame:
    """Volumes of which slices are wanted, each once, with the ``wanted_slices`` of its series sorted by name; a series' slices are few enough for one row."""
    from lodestar.functions.names import series_id

    by = wanted.groupBy(series_id(F.col(name)).alias(series)).agg(F.array_sort(F.collect_set(name)).alias("wanted_slices"))
    return volumes.join(by, series)


def split_counts(samples: DataFrame, groups: list[str], subset: str = "subset") -> DataFrame:
    n = lambda what: F.sum((F.col(subset) == what).cast("bigint"))
    return samples.groupBy(*groups).agg(n("training").alias("train"), n("validation").alias("validation"), n("unmatched").alias("unmatched"))


def with_split_counts(summary: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    return summary.join(counts, keys, "left").fillna(0, ["train", "validation", "unmatched"])


def audit(stats: DataFrame, group: str, order: str, configs: list[FilterConfig], series: str, overview: DataFrame, name: str, subset: str) -> DataFrame:
    """What each filter takes and keeps of each group, and how the kept samples fall into training, validation and neither; a series in both counts in both."""
    kept = None
    for c in configs:
        own = filter_samples(stats, group, order, c).where("reason is null").select(F.lit(c.name).alias("config"), group, series)
        kept = own if kept is None else kept.unionByName(own)
    parts = overview.groupBy(F.col(name).alias(series)).agg(F.bool_or(F.col(subset) == "training").alias("__t"), F.bool_or(F.col(subset) == "validation").alias("__v"))
    rows = kept.join(parts, series, "left").withColumns({"__t": F.coalesce("__t", F.lit(False)), "__v": F.coalesce("__v", F.lit(False))})
    n = lambda what: F.sum(what.cast("bigint"))
    counts = rows.groupBy("config", group).agg(n(F.col("__t")).alias("train"), n(F.col("__v")).alias("validation"), n(~F.col("__t") & ~F.col("__v")).alias("unmatched"))
    return with_split_counts(filter_audit(stats, group, configs), counts, ["config", group])


# Draws that have to be those of a numpy generator depend on the number of rows alone. Rows get their places in
# Spark; tasks make the generator's numbers and look up their rows' places.

#: Rows of a group that a draw may choose from: a generator's permutation can't be made in parts, so each task makes all of it (8 bytes a row).
MAX_DRAW = 20_000_000


@functools.lru_cache(maxsize=8)
def _permuted(seed: int, count: int) -> np.ndarray:
    """Where each place of a list goes when the generator permutes the list."""
    out = np.empty(count, np.int64)
    out[np.random.default_rng(seed).permutation(count)] = np.arange(count)
    return out


@functools.lru_cache(maxsize=1024)
def _chosen(seed: int, count: int, wanted: int) -> np.ndarray:
    return np.sort(np.random.default_rng(seed).choice(count, wanted, replace=False))


def permuted(place: Column, count: Column, seed: int) -> Column:
    """Place of a row after the generator's permutation of ``count`` rows."""

    @F.pandas_udf("bigint")
    def run(place: pd.Series, count: pd.Series) -> pd.Series:
        at, out = place.to_numpy(), np.empty(len(place), np.int64)
        for n in count.unique():
            own = count.to_numpy() == n
            out[own] = _permuted(seed, int(n))[at[own]]
        return pd.Series(out)

    return run(place, count)


def drawn(place: Column, count: Column, wanted: int, seed: int) -> Column:
    """Whether a row is among the ``wanted`` ones that the generator draws from ``count`` rows without putting back; all are if there are no more."""

    @F.pandas_udf("boolean")
    def run(place: pd.Series, count: pd.Series) -> pd.Series:
        at, out = place.to_numpy(), np.ones(len(place), bool)
        for n in count.unique():
            if n > wanted:
                own = count.to_numpy() == n
                out[own] = np.isin(at[own], _chosen(seed, int(n), wanted))
        return pd.Series(out)

    return run(place, count)


def _listed(rows: DataFrame, groups: list[str], order: list) -> DataFrame:
    out = written(places(rows, groups, order), "draw")
    if big := out.where(F.col("members") > MAX_DRAW).limit(1).collect():
        raise ValueError(f"{big[0]['members']} rows are too many to draw from")
    return out


def kfold(samples: DataFrame, patient: str, folds: int, seed: int) -> DataFrame:
    """``fold`` of each sample by its patient: patients sorted as text, permuted, dealt in turn. Samples without a patient are an error, as their fold can't be known."""
    if samples.where(F.col(patient).isNull()).limit(1).count():
        raise ValueError(f"samples without {patient}")
    ids = _listed(samples.select(patient).distinct(), [], [F.col(patient).cast("string")])
    count = ids.count()
    if not 2 <= folds <= count:
        raise ValueError(f"{count} patients can't make {folds} folds")
    of = ids.select(patient, (permuted(F.col("place"), F.col("members"), seed) % folds).cast("int").alias("fold"))
    return samples.join(of, patient)


def random_cap(samples: DataFrame, group: str, name: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` samples of each group, drawn without replacement in the order of names; the generator starts anew for each group. Null is a group."""
    rows = _listed(samples, [group], [name])
    return rows.where(drawn(F.col("place"), F.col("members"), cap, seed)).select(*samples.columns)


def train_subsample(train: DataFrame, name: str, count: int, seed: int) -> DataFrame:
    names = _listed(train.select(name).where(F.col(name).isNotNull()).distinct(), [], [name])
    there = names.count()
    if not 0 < count <= there:
        raise ValueError(f"{count} of {there} samples can't be drawn")
    # as many as there are come as they are, as if drawn
    return train.join(names.where(drawn(F.col("place"), F.col("members"), count, seed)).select(name), name, "left_semi")


def choose(samples: DataFrame, name: str, count: int, start: int = 0, how: str = "even", seed: int = 0) -> DataFrame:
    """``count`` samples from place ``start`` of the sorted names on: the first, evenly spaced or random ones.

    All from there on, if any, where ``count`` is 0 or reaches the whole list. No names at all, and a smaller ``count`` with no name from ``start`` on, are errors.
    """
    names = written(places(samples.select(name).where(F.col(name).isNotNull()).distinct(), [], [name]), "choose")
    there = names.count()
    if not there:
        raise ValueError("there are no samples to choose from")
    rest = names.where(F.col("place") >= start).withColumn("place", F.col("place") - start)
    if 0 < count < there:
        left = there - start
        if left <= 0:
            raise ValueError(f"there is no place {start} in a list of {there}")
        if how == "random":
            if left > MAX_DRAW:
                raise ValueError(f"{left} rows are too many to draw from")
            rest = rest.where(drawn(F.col("place"), F.lit(left), count, seed))
        elif how in ("first", "even"):
            rest = rest.where(F.col("place") < count if how == "first" else evenly_spaced(F.col("place"), F.lit(left), F.lit(count)))
        else:
            raise ValueError(f"unknown choice {how!r}")
    return samples.join(rest.select(name), name, "left_semi")


def smoke_pick(samples: DataFrame, name: str, count: int) -> DataFrame:
    """Evenly spaced samples in the order of names: the truncated steps from the first to the last; all if there are no more than ``count``."""
    if count <= 0:
        return samples.limit(0)
    rows = places(samples, [], [name])
    # unlike ``choose``, more steps than samples name some of them twice, which gives each once
    return rows.where(evenly_spaced(F.col("place"), F.col("members"), F.lit(count))).select(*samples.columns)


def image_split(samples: DataFrame, name: str, part: str, seed: int) -> DataFrame:
    """Parts dealt anew over single images, with the sizes they had: test first, then val, then train."""
    sizes = {r[0]: r[1] for r in samples.groupBy(part).count().where(F.col(part).isin("test", "val", "train")).collect()}
    test, val = sizes.get("test", 0), sizes.get("test", 0) + sizes.get("val", 0)
    rows = _listed(samples.where(F.col(part).isin("test", "val", "train")), [], [name])
    at = permuted(F.col("place"), F.col("members"), seed)
    return rows.withColumn("place", at).withColumn(part, F.when(F.col("place") < test, "test").when(F.col("place") < val, "val").otherwise("train")).select(*samples.columns)


def inner_validation(train: DataFrame, group: str, case: str, count: int, seed: int) -> DataFrame:
    """``part`` (val or train) by case, ``count`` cases of each group; the generator starts anew for each group. Null is a group, and a case."""
    cases = _listed(train.select(group, case).distinct(), [group], [case])
    if few := cases.where(F.col("members") <= count).limit(1).collect():
        raise ValueError(f"{few[0][group]} has {few[0]['members']} cases, not more than {count}")
    val = cases.where(drawn(F.col("place"), F.col("members"), count, seed)).select(F.col(group).alias("__group"), F.col(case).alias("__case"), F.lit(True).alias("__val"))
    joined = train.join(val, F.col(group).eqNullSafe(F.col("__group")) & F.col(case).eqNullSafe(F.col("__case")), "left")
    return joined.withColumn("part", F.when(F.col("__val"), "val").otherwise("train")).select(*train.columns, "part")
