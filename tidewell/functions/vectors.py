"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    """Up to the shorter one's length."""
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """Scaled to length one; the zero vector stays."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))
