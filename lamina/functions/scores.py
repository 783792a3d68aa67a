"""Vector and ranking functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine; null if a vector is null or all zero."""
    return 1 - normalised_dot(a, b)


def normalised_dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of the two unit vectors; null if a vector is null or all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_problem(v: str | Column, size: int) -> Column:
    """Why a vector can't be stored: empty, dimension, not_finite, zero; null if it can."""
    x = col(v)
    return (
        F.when(x.isNull() | (F.size(x) == 0), "empty")
        .when(F.size(x) != size, "dimension")
        .when(F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), "not_finite")
        .when(F.forall(x, lambda e: e == 0), "zero")
    )


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def rrf_term(rank: str | Column, weight: float = 1.0, k: int = 60) -> Column:
    """weight / (k + rank); 0 where there is no rank."""
    return F.coalesce(F.lit(float(weight)) / (F.lit(k) + col(rank)), F.lit(0.0))
