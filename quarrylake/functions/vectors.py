"""Vector expressions on arrays of numbers, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of zeros, of other lengths or with nulls."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def constant(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n))
