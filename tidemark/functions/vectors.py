"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for null, empty or zero vectors and for vectors of different lengths."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))
