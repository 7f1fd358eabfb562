"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def truncate_normalize(v: Column, dimensions: int) -> Column:
    return normalize(F.slice(v, 1, dimensions))


def parse_vector(text: Column) -> Column:
    """``"[1.0,2.5]"`` as an array."""
    return F.from_json(text, "array<float>")
