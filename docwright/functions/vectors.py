"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pad(v: Column, size: int = 1536) -> Column:
    """Cut to size or filled with zeros, which leaves cosines as they are."""
    return F.when(F.size(v) >= size, F.slice(v, 1, size)).otherwise(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size(v))))


def validity(v: Column) -> Column:
    """null, empty, zero (its first ten components are 0) or valid."""
    return F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.forall(F.slice(v, 1, 10), lambda x: x == 0), "zero").otherwise("valid")
