"""Arithmetic on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_zero(vector: Column) -> Column:
    """All components are 0; true for an empty vector."""
    return F.forall(vector, lambda v: v == 0)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)
