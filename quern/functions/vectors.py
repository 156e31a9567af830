"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NaN if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), size))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    powers = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / _total(powers))


def argmax(xs: Column) -> Column:
    """0-based place of the largest value, the first of equal ones."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def mean_std(xs: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of an array; (0, 0) for none, (x, 0) for one."""
    n = F.size(F.coalesce(xs, F.array().cast("array<double>")))
    mean = F.when(n == 0, 0.0).otherwise(F.try_divide(_total(xs), n))
    spread = _total(F.transform(xs, lambda x: (x - mean) * (x - mean)))
    return mean, F.when(n < 2, 0.0).otherwise(F.sqrt(F.try_divide(spread, n - 1)))
