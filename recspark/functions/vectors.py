"""Vector expressions on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HISTORY_WEIGHT = 0.7
QUERY_WEIGHT = 0.3
NORM_EPSILON = 1e-8


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.transform(as_doubles(vector), lambda x: x * x)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def unit(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(as_doubles(vector), lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def mixed(history: Column, query: Column) -> Column:
    """Weighted sum of a history vector and a query vector, not yet normalised."""
    return F.zip_with(
        as_doubles(history), as_doubles(query), lambda h, q: h * F.lit(HISTORY_WEIGHT) + q * F.lit(QUERY_WEIGHT)
    )


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
