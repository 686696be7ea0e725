"""Distances between array columns and a fixed vector, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Smaller is nearer: squared l2 distance, 1 - cosine, or 1 - dot product. Null for another length or a zero vector's cosine."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric '{metric}' (expected one of {', '.join(METRICS)})")
    q = F.array(*(F.lit(float(x)) for x in query))
    if metric == "l2":
        value = _sum(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))
    elif metric == "dot":
        value = 1 - dot(vector, q)
    else:
        value = 1 - dot(vector, q) / F.nullif(F.sqrt(dot(vector, vector)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5), F.lit(0.0))
    return F.when(F.size(vector) == len(query), value)
