"""Vector arithmetic on array columns, all built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def squared_mahalanobis(point: Column, centre: Column, variance: Column) -> Column:
    """With a diagonal covariance; dimensions of no variance don't count."""
    squares = F.zip_with(point, centre, lambda x, c: (x - c) * (x - c))
    return total(F.zip_with(squares, variance, lambda d, v: F.coalesce(F.try_divide(d, v), F.lit(0.0))))


def doubles(values: Column) -> Column:
    return values.cast("array<double>")
