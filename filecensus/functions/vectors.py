"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 for empty vectors, unlike lengths or a zero norm."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    comparable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms != 0)
    return F.when(comparable, _dot(a, b) / norms).otherwise(0.0)
