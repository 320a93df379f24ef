"""Places of rows in sorted groups, without a group or the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.scratch import written


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def places(rows: DataFrame, groups: list[str], order: list[Column | str], place: str = "place", members: str = "members") -> DataFrame:
    """``rows`` with ``place``, from 0, in their group by ``order``, and ``members``, the group's rows; columns of these names are replaced.

    Rows are dealt into ranges of (group, order); a row's place is its place in its range plus
    the group's rows in the ranges before, of which there is one count a range and group.
    Null groups are groups; rows that are equal in ``order`` get places in any order.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt_to, group, inside, n, dealt_again, group_again, before, all_ = free_names(rows, "range", "group", "inside", "n", "range_of", "group_of", "before", "in_group")
    ranges = rows.repartitionByRange(*map(F.col, groups), *by) if groups or by else rows
    dealt = written(ranges.withColumn(dealt_to, F.spark_partition_id()), "places")
    dealt = dealt.withColumn(group, F.struct(*groups) if groups else F.lit(0))
    counts = dealt.groupBy(dealt_to, group).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(group).orderBy(dealt_to).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select(
        F.col(dealt_to).alias(dealt_again),
        F.col(group).alias(group_again),
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before),
        F.sum(n).over(Window.partitionBy(group)).alias(all_),
    )
    out = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(dealt_to, group).orderBy(*by)) - 1)
    out = out.join(counts, (F.col(dealt_to) == F.col(dealt_again)) & F.col(group).eqNullSafe(F.col(group_again)))
    kept = [c for c in rows.columns if c.lower() not in (place.lower(), members.lower())]
    return out.select(*kept, (F.col(before) + F.col(inside)).alias(place), F.col(all_).alias(members))
