"""Similarity of two embedding columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def face_similarity(a: Column, b: Column) -> Column:
    """Cosine mapped to 0..1; a missing or zero embedding gives 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    scaled = (_dot(a, b) / F.nullif(norms, F.lit(0.0)) + 1.0) / 2.0
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), F.lit(0.0))
