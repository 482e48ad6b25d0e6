"""Element-wise and reducing functions of array columns. A mismatch of lengths, a zero divisor or a zero norm to divide by fails the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")))


def _nonzero(x: Column, value: Column, why: str) -> Column:
    return F.when(x != 0, value).otherwise(F.raise_error(F.lit(why)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and not again for each element of a vector."""
    return F.get(F.transform(F.array(value), body), 0)


def vec_add(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vec_sub(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def vec_mul(a: Column, b: Column) -> Column:
    """Element-wise product."""
    return _same(a, b, F.zip_with(a, b, lambda x, y: x * y))


def vec_scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(float(factor)))


def vec_div(a: Column, divisor: float) -> Column:
    if divisor == 0:
        raise ZeroDivisionError("vector divided by zero")
    return F.transform(a, lambda x: x / F.lit(float(divisor)))


def vec_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def vec_mean(a: Column) -> Column:
    """0 for an empty vector."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(vec_sum(a) / F.greatest(F.size(a), F.lit(1)))


def vec_dot(a: Column, b: Column) -> Column:
    return vec_sum(vec_mul(a, b))


def norm_squared(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(norm_squared(a))


def distance_squared(a: Column, b: Column) -> Column:
    return vec_sum(_same(a, b, F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_squared(a, b))


def normalize(a: Column) -> Column:
    return _let(norm(a), lambda n: _nonzero(n, F.transform(a, lambda x: x / n), "zero vector has no direction"))


def is_same(a: Column, b: Column) -> Column:
    return a == b


def vec_hash(a: Column) -> Column:
    return F.hash(a)


def min_max_scale(a: Column) -> Column:
    """To [0, 1]; 0.5 throughout if all elements are equal."""

    def scaled(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        return F.transform(a, lambda x: F.when(high == low, F.lit(0.5)).otherwise((x - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)))

    return _let(F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high")), scaled)


def standardize(a: Column) -> Column:
    """To mean 0 and population deviation 1; zeros if there is no deviation."""

    def scaled(mean: Column) -> Column:
        spread = F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / F.greatest(F.size(a), F.lit(1)))
        return _let(spread, lambda d: F.transform(a, lambda x: F.when(d == 0, F.lit(0.0)).otherwise((x - mean) / F.when(d == 0, F.lit(1.0)).otherwise(d))))

    return _let(vec_mean(a), scaled)
