"""Vector functions over ARRAY<FLOAT|DOUBLE> columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit vector; lengths under 1e-12 count as 1e-12."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def query_vector(query: Column, interests: Column | None) -> Column:
    """Normalised sum of query and interests, or of the query alone where there are none."""
    if interests is None:
        return normalize(query)
    both = F.zip_with(query, interests, lambda x, y: x.cast("double") + y.cast("double"))
    return normalize(F.when(interests.isNotNull(), both).otherwise(F.transform(query, lambda x: x.cast("double"))))
