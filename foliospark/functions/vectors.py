"""Vector functions as Spark columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Divided by the norm; the zero vector stays as it is."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; null where a norm is zero."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))))


def is_usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite values that are not all zero; null gives false."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
