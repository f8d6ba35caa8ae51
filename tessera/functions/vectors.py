"""Vector column expressions (JVM higher-order functions, computed in DOUBLE)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine similarity; a zero vector gives NaN (0/0), like SQL engines."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den == 0, F.lit(float("nan"))).otherwise(dot(a, b) / den)
