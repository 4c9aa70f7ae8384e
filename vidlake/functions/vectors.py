"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """a divided by its length; a vector of length 0 stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_unit(a: Column, b: Column) -> Column:
    """Distance of the two directions."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine(a, b)))
