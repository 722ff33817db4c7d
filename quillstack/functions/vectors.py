"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, in double precision; null if a side is null or the lengths differ."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(product, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """A vector of length 1; a zero vector stays zero."""
    size = norm(a) + F.lit(1e-9)
    return F.transform(a, lambda x: x / size)


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def nearest(distances: list[tuple[str, Column]]) -> Column:
    """The name with the least distance, the first of equal ones; null distances give null."""
    d = F.array(*[c for _, c in distances])
    return F.get(F.array(*[F.lit(n) for n, _ in distances]), F.array_position(d, F.array_min(d)).cast("int") - 1)
