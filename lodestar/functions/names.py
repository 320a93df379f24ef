"""Names of slices, series and patients as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_of(name: Column) -> Column:
    """The scan sequence a file name tells; "space" wins over "t2", and that over "t1"."""
    low = F.lower(name)
    return F.when(low.contains("space"), "T2_SPACE").when(low.contains("t2"), "T2").when(low.contains("t1"), "T1").otherwise("Unknown")


def wanted_sequences(text: str | None) -> list[str] | None:
    """The upper-cased names of a comma-separated list; None: no filter."""
    names = sorted({part.strip().upper() for part in (text or "").split(",")} - {""})
    return names or None


def series_id(name: Column) -> Column:
    """Without ".npz" and what follows the last "_s"."""
    return F.regexp_replace(F.regexp_replace(name, r"\.npz$", ""), r"_s(?!.*_s).*$", "")


def patient_id(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def slice_index(name: Column) -> Column:
    """The number after the last "_s", -1 if there is none."""
    stem = F.regexp_replace(name, r"\.npz$", "")
    return F.coalesce(F.regexp_extract(stem, r"_s([+-]?\d{1,9})$", 1).try_cast("int"), F.lit(-1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def slice_name(base: Column, index: Column) -> Column:
    return F.format_string("%s_s%03d.npz", base, index)
