"""Vector expressions.  For ranking whole tables use ``operators.knn``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x * x))


def normalize(vec: Column) -> Column:
    """Unit vector; NULL for a zero vector."""
    # As an element of a list the norm is taken once, not for each component.
    norms = F.array(F.nullif(l2_norm(vec), F.lit(0.0)))
    return F.transform(norms, lambda n: F.when(n.isNotNull(), F.transform(as_double(vec), lambda x: x / n)))[0]


def truncate(vec: Column, dims: int) -> Column:
    """Leading ``dims`` components, renormalised."""
    return normalize(F.slice(vec, 1, dims))


def cosine_score(a: Column, b: Column) -> Column:
    """(1 + cos) / 2, NULL when either vector has no direction."""
    norms = F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))
    return (1 + dot(a, b) / norms) / 2


def has_direction(vec: Column) -> Column:
    """False for missing and for all-zero vectors, which cannot be ranked."""
    return F.coalesce(l2_norm(vec) > 0, F.lit(False))
