"""Labels, images and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

INF = float("inf")


def map_label(label: Column) -> Column:
    """Raw labels to classes: 1 to 99 are 1, 100 is 2, 200 and more are 3, all else is 0."""
    return F.when(label.between(1, 99), 1).when(label == 100, 2).when(label >= 200, 3).otherwise(0)


def ratio(part: Column, whole: Column, empty: float = float("nan")) -> Column:
    """A quotient as double; ``empty`` where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty))


def minmax(image: Column) -> Column:
    """An image scaled to 0 to 1; a constant one becomes zeros."""
    low, high = F.array_min(image), F.array_max(image)
    return F.transform(image, lambda x: F.when(high > low, (x.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))).otherwise(F.lit(0.0)))


def one_hot(label: Column, classes: int) -> Column:
    return F.array(*((label == k).cast("int") for k in range(classes)))


def argmax(scores: Column) -> Column:
    """Place of the first largest, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sagittal_axis(shape: Column) -> Column:
    """Place of the first smallest side."""
    return (F.array_position(shape, F.array_min(shape)) - 1).cast("int")


def array_spacings(spacing: Column) -> Column:
    """(x, y, z) as (z, y, x)."""
    return F.reverse(spacing)


def resized_spacing(spacing: Column, original: Column, target: Column) -> Column:
    return (spacing * original.cast("double") / target.cast("double")).cast("float")


def diagonal_mm(height: Column, width: Column, row_mm: Column, col_mm: Column) -> Column:
    return F.hypot(height * row_mm, width * col_mm)


def optional_float(text: Column) -> Column:
    """A number; null for blank and for inf."""
    return F.when(F.lower(text).isin("", "inf"), F.lit(None)).otherwise(text.try_cast("double"))


def strict_score(text: Column) -> Column:
    """A finite number from 0 to 1, or an error."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(0, 1), x).otherwise(F.raise_error(F.concat(F.lit("not a score from 0 to 1: "), F.coalesce(text, F.lit("null")))).cast("double"))


def four_decimals(x: Column) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.format_string("%.4f", x))


def json_safe(x: Column, kind: DataType) -> Column:
    """A value of type ``kind`` for JSON, nested ones too: numbers stay numbers, those that aren't finite become the words inf, -inf and nan."""
    if isinstance(kind, (DoubleType, FloatType)):
        word = F.when(F.isnan(x), "nan").when(x == INF, "inf").when(x == -INF, "-inf")
        return F.when(word.isNotNull(), word.cast("variant")).otherwise(x.cast("variant"))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: json_safe(e, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, v: json_safe(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(json_safe(x.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    return x


def json_text(rows: StructType, keep_nulls: bool = True) -> Column:
    """The JSON object of a row with the fields of ``rows``."""
    fields = [json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": str(not keep_nulls).lower()})


def fingerprint(names: Column) -> Column:
    """SHA-256 of names, one a line, no line break at the end."""
    return F.sha2(F.array_join(names, "\n"), 256)


def evenly_spaced(row: Column, count: Column, cap: Column) -> Column:
    """Whether row ``row`` (from 0) of ``count`` is among ``cap`` evenly spaced ones, as truncated floating point steps pick them."""
    step = (count - 1).cast("double") / F.greatest(cap - 1, F.lit(1)).cast("double")
    near = F.floor(row / step)
    at = lambda i: (i <= cap - 2) & (F.floor(i * step) == row)  # noqa: E731  the last one is the last row, whatever its product rounds to
    picked = at(near) | at(near + 1) | (row == count - 1)
    return cap.isNull() | (count <= cap) | F.when(cap == 1, row == 0).otherwise(picked)


def ensemble(maps: list[Column]) -> Column:
    """Mean of probability arrays, element by element."""
    total = maps[0]
    for m in maps[1:]:
        total = F.zip_with(total, m, lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(maps))
