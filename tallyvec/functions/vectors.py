"""Quantization and distances as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 14


def rounded(x: Column, scale: int, least: int, most: int, kind: str) -> Column:
    """x * scale in 32-bit floats, rounded half away from zero, clamped."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.round((x.cast("float") * F.lit(scale).cast("float")).cast("double")).cast("int"))).cast(kind)


def affine(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """(x - offset) / scale, in 32-bit floats; the identity by default."""
    if (scale, offset) == (1.0, 0.0):
        return x
    return ((x.cast("float") - F.lit(offset).cast("float")).cast("float") / F.lit(scale).cast("float")).cast("float")


def to_i16(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return rounded(affine(x, scale, offset), 32767, -32768, 32767, "smallint")


def to_i8(x: Column) -> Column:
    return rounded(x, 127, -128, 127, "tinyint")


def i16_to_i8(x: Column) -> Column:
    """Divided by 258, truncating; keeps the sign and the range."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.try_divide(x.cast("int"), F.lit(258)).cast("int"))).cast("tinyint")


def vector(raw: Column, dims: int = DIMS) -> Column:
    """The first dims values; missing ones are 0."""
    return F.slice(F.concat(F.coalesce(raw, F.array().cast("array<float>")), F.array_repeat(F.lit(0).cast("float"), dims)), 1, dims)


def vector_i16(v: Column) -> Column:
    return F.transform(v, lambda x: to_i16(x))


def vector_i8(v: Column) -> Column:
    return F.transform(v, to_i8)


def vector_i16_to_i8(v: Column) -> Column:
    return F.transform(v, i16_to_i8)


def squared_distance(a: Column, b: Column) -> Column:
    """Exact, as bigint: both sides are widened before they are subtracted."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y.cast("bigint")) * (x.cast("bigint") - y.cast("bigint")))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x)


def joined(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
