"""Arithmetic on vectors as column expressions, in double precision whatever the stored type.

Vectors of different lengths are cut to the shorter, as a missing tail adds nothing to a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _cut(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column, same_length: bool = True) -> Column:
    a, b = (a, b) if same_length else _cut(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    below = norm(a) * norm(b)
    return F.when(below > 0, dot(a, b) / below).otherwise(F.lit(0.0))


def normalized(v: Column) -> Column:
    """A zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v)))[0]


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0)))


def plus_times(a: Column, factor: Column | float, b: Column) -> Column:
    factor = F.lit(factor) if not isinstance(factor, Column) else factor
    return F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) + factor * F.coalesce(y.cast("double"), F.lit(0.0)))


def scaled(v: Column, factor: Column | float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * factor)


def rounded(v: Column, digits: int = 6) -> Column:
    # Adding zero turns a negative zero, which other engines print otherwise, into zero.
    return F.transform(v, lambda x: F.round(x, digits) + F.lit(0.0))


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def elementwise(df: DataFrame, vector: str, keys: list[str], how=F.avg, weight: str | None = None, alias: str = "vector") -> DataFrame:
    """The element-wise mean or sum of vectors by keys: an aggregate by position, so groups of any size combine map-side."""
    x = F.col("__x").cast("double") * (F.col(weight) if weight else F.lit(1.0))
    flat = df.select(*keys, *([weight] if weight else []), F.posexplode(vector).alias("__pos", "__x"))
    by = flat.groupBy(*keys, "__pos").agg(how(x).alias("__x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda s: s["__x"])
    return by.groupBy(*keys).agg(ordered.alias(alias))
