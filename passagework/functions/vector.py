"""Dense-vector expressions over array columns; everything is summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; a zero vector scores 0.  Norms that are stored save two passes over the arrays."""
    scale = (l2_norm(a) if norm_a is None else norm_a) * (l2_norm(b) if norm_b is None else norm_b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def sq_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance by |a|^2 - 2ab + |b|^2, never below zero."""
    return F.greatest(dot(a, a) - 2 * dot(a, b) + dot(b, b), F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit vector in double; a zero vector stays as it is."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
