"""Vector functions as Column expressions over array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave import constants as K


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors or unequal lengths; a zero denominator counts as 1."""
    root = F.sqrt(squared_norm(a) * squared_norm(b))
    value = _dot(a, b) / F.when(root == 0, 1.0).otherwise(root)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value), F.lit(0.0))


def vector_valid(v: Column, max_dim: int | None = None) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sized = F.size(v) >= 1 if max_dim is None else F.size(v).between(1, max_dim)
    return F.coalesce(sized & finite, F.lit(False))
