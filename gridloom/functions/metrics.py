"""Aggregate columns for forecast errors. Undefined values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mse_in_order(by: str, y: Column, p: Column) -> Column:
    """mse(), summed in the order of `by`: its last bits, which decide between errors that are equal but for rounding, are the same
    however the rows are dealt."""
    squares = F.transform(F.array_sort(F.collect_list(F.struct(by, ((y - p) * (y - p)).alias("e")))), lambda x: x["e"])
    return F.try_divide(F.aggregate(squares, F.lit(0.0), lambda acc, e: acc + e), F.size(squares))


def wape(y: Column, p: Column) -> Column:
    """Null if the actual values sum to zero."""
    return F.try_divide(F.sum(F.abs(y - p)), F.sum(F.abs(y)))


def pinball(y: Column, q: Column, level: Column) -> Column:
    e = y - q
    return F.avg(F.greatest(level * e, (level - 1) * e))


def crps(y: Column, q: Column, level: Column) -> Column:
    """Approximated by twice the mean pinball loss over the levels."""
    return 2 * pinball(y, q, level)


def scaled(error: Column, scale: Column) -> Column:
    """error / scale; null for a null or zero scale."""
    return F.try_divide(error, F.when(scale != 0, scale))


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(y.between(low, high).cast("double"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where either column is constant, for which corr() divides by zero."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
