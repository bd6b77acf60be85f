"""Vector and probability columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8  # norm floor of the cosine


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with floored norms: max(norm squared, EPS squared) under the root."""
    floor = F.lit(EPS * EPS)
    return dot(a, b) / (F.sqrt(F.greatest(dot(a, a), floor)) * F.sqrt(F.greatest(dot(b, b), floor)))


def softmax_at(logits: Column, index: Column) -> Column:
    """Softmax probability of one entry (0-based), shifted by the maximum."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.exp(F.element_at(logits, index + 1) - top) / total


def evidence(similarity: Column, power: float = 2.0) -> Column:
    return F.pow(F.greatest(similarity, F.lit(0.0)), F.lit(power))
