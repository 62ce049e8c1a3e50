"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def centred(v: Column) -> Column:
    """Subtract the vector's own mean."""
    return F.transform(v, lambda x: x - total(v) / F.size(v))


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def unit(v: Column, tiny: float = 0.0, eps: float = 0.0) -> Column:
    """Divide by the L2 norm; vectors with norm at or below ``tiny`` stay as they are."""
    n = norm(v)
    return F.when(n <= tiny, v).otherwise(scaled(v, 1.0 / (n + eps)))


def lerp(a: Column, b: Column, ratio: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * ratio)


def fit_width(v: Column, width: int) -> Column:
    """Zero-pad or truncate to exactly ``width`` values."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)
