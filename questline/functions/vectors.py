"""Similarity of embedding vectors as a native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double.

    Null when widths differ, a vector has no length, or an element is null, NaN or infinite.
    """
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    # NaN counts as larger than any number, so the upper bound rules it out as well.
    return F.when((F.size(a) == F.size(b)) & (norm > 0) & (norm < float("inf")), _dot(a, b) / norm)
