"""Cosine similarity of one query vector with all stored vectors.

Null vectors, other lengths and zero norms score 0; an all-zero query has no results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of a column with a constant vector, in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    return F.when((F.size(v) == len(query)) & (norm > 0) & F.lit(size > 0), dot / (norm * F.lit(size or 1.0))).otherwise(F.lit(0.0))


def search(store: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """``(id, score)`` of the ``k`` best, ties by id; scores are rounded to 5 places."""
    if not any(query):
        return store.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).where("false")
    return store.select(F.col(key).alias("id"), F.round(F.coalesce(cosine(F.col(vector), query), F.lit(0.0)), 5).alias("score")).orderBy(F.desc("score"), "id").limit(k)
