"""Integrity of pairs and lists, fingerprints and manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_status(images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """pair, image_only or mask_only for each name."""
    a, b = images.select(key, F.lit(True).alias("i")), masks.select(key, F.lit(True).alias("m"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("i") & F.col("m"), "pair").when(F.col("i"), "image_only").otherwise("mask_only").alias("status"))


def raw_audit(volumes: DataFrame, groups: list[str], has_mask: str) -> DataFrame:
    return volumes.groupBy(*groups).agg(F.count("*").alias("series_count"), F.sum(F.col(has_mask).cast("bigint")).alias("mask_count"))


def duplicates(names: DataFrame, key: str) -> DataFrame:
    return names.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def cohort_fingerprint(names: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n, sha256): rows of each group, and the digest of its sorted names, one a line, no line break at the end; null names are rows without a line.

    A group's names pass through one task, as a digest has to, in batches of a sorted partition: no row and no task holds them.
    """
    kind = names.schema[group].dataType.simpleString()
    rows = names.select(F.col(group).alias("g"), F.col(key).cast("string").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, digest = None, 0, None  # of the group that is being read
        done = lambda: pa.record_batch([at, pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["g", "n", "sha256"])
        first = True
        for batch in batches:
            cells, groups = batch.column(1), batch.column(0)
            values = groups.to_pylist()
            start = 0
            for end in range(1, len(values) + 1):
                if end < len(values) and values[end] == values[start]:
                    continue
                own = groups.slice(start, 1)
                if digest is None or own != at:
                    if digest is not None:
                        yield done()
                    at, n, digest, first = own, 0, hashlib.sha256(), True
                lines = [x for x in cells.slice(start, end - start).to_pylist() if x is not None]
                if lines:
                    digest.update((("" if first else "\n") + "\n".join(lines)).encode())
                    first = False
                n += end - start
                start = end
        if digest is not None:
            yield done()

    found = rows.repartition("g").sortWithinPartitions("g", "name").mapInArrow(run, f"g {kind}, n bigint, sha256 string")
    return found.withColumnRenamed("g", group)


def manifest_diff(ours: DataFrame, theirs: DataFrame, ordered: bool = True) -> DataFrame:
    """Rows of either manifest that the other lacks, with their ``side``. ``ordered``: both have to have ``position``, and a row counts as equal only at its place; else as often as it occurs anywhere."""
    if ordered and not ("position" in ours.columns and "position" in theirs.columns):
        raise ValueError("manifests are compared in order by their column position")
    columns = [c for c in ours.columns if ordered or c != "position"]
    a, b = ours.select(*columns), theirs.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("ours")).unionByName(b.exceptAll(a).withColumn("side", F.lit("theirs")))


def require_pairs(wanted: DataFrame, images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """``wanted``, whose names all have an image and a mask; a name that lacks one fails the job."""
    there = pair_status(images, masks, key).select(key, "status")
    joined = wanted.join(there, key, "left")
    wrong = F.coalesce(F.col("status") != "pair", F.lit(True))
    checked = F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("no pair for"), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return joined.where(checked).select(*wanted.columns)


def expected_present(expected: DataFrame, images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """(key, fault): expected names without a pair are "missing", names of either side that weren't expected are "unexpected"; none if all is as it should be."""
    want, i, m = (df.select(key).distinct() for df in (expected, images, masks))
    missing = want.exceptAll(i.intersect(m)).withColumn("fault", F.lit("missing"))
    return missing.unionByName(i.union(m).distinct().exceptAll(want).withColumn("fault", F.lit("unexpected")))
