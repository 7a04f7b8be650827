"""Vector columns, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """NaN if a norm is zero, 0 if a side is missing."""
    scale = norm(a) * norm(b)
    value = F.when(scale == 0, F.lit(float("nan"))).otherwise(dot(a, b) / F.when(scale == 0, F.lit(1.0)).otherwise(scale))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(value)


def negative_distance(a: Column, b: Column) -> Column:
    return -F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def transe_score(h: Column, r: Column, t: Column) -> Column:
    """The nearer head + relation is to the tail, the higher."""
    return negative_distance(F.zip_with(h, r, lambda x, y: x.cast("double") + y.cast("double")), t)


def distmult_score(h: Column, r: Column, t: Column) -> Column:
    return dot(F.zip_with(h, r, lambda x, y: x.cast("double") * y.cast("double")), t)
