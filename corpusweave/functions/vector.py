"""Vector columns: higher-order functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine score; null where a vector is null, empty or of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def best_cosine(query: Column, vectors: Column) -> Column:
    """Highest score of several vectors of one document."""
    return F.array_max(F.transform(vectors, lambda v: cosine(query, v)))


def blended(text_score: Column, vector_score: Column, text_weight: float = 0.4) -> Column:
    return text_weight * text_score + (1 - text_weight) * vector_score
