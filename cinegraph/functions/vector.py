"""Vector expressions over float arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_raw(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine_unit(a: Column, b: Column) -> Column:
    """The cosine mapped to [0, 1]."""
    return (1 + cosine_raw(a, b)) / 2
