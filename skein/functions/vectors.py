"""Vector expressions over array columns; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a vector is zero; null where one is null."""
    size = norm(a) * norm(b)
    return F.when(size > TINY, dot(a, b) / size).when(size.isNotNull(), F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2, the scale of the graph thresholds."""
    return (F.lit(1.0) + cosine(a, b)) / 2.0


def clipped(score: Column) -> Column:
    """Into [0, 1]; null gives 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), F.lit(0.0))
