"""Column functions over arrays of doubles: window scales, their application, distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale rules by name.
SCALES = ("raw", "znorm", "mean", "rms")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: an expression used inside a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(array_sum(a), F.size(a))


def array_std(a: Column, mean: Column) -> Column:
    """Population standard deviation around a given mean."""
    return let(mean, lambda m: F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)), F.size(a))))


def array_rms(a: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v), F.size(a)))


def one_if_zero(x: Column) -> Column:
    return F.when(x == 0.0, F.lit(1.0)).otherwise(x)


def scale_params(a: Column, kind: str) -> Column:
    """struct(loc, scale) of a window. A scale of exactly zero becomes one; a negative mean stays negative."""
    if kind == "raw":
        return F.struct(F.lit(0.0).alias("loc"), F.lit(1.0).alias("scale"))
    if kind == "mean":
        return F.struct(F.lit(0.0).alias("loc"), one_if_zero(array_mean(a)).alias("scale"))
    if kind == "rms":
        return F.struct(F.lit(0.0).alias("loc"), one_if_zero(array_rms(a)).alias("scale"))
    if kind == "znorm":
        mean = array_mean(a)
        return F.struct(mean.alias("loc"), one_if_zero(array_std(a, mean)).alias("scale"))
    raise ValueError(f"unknown scale {kind!r}; known are {SCALES}")


def standardise(a: Column, p: Column) -> Column:
    return let(p, lambda q: F.transform(a, lambda v: (v - q["loc"]) / q["scale"]))


def restore(a: Column, own: Column, query: Column) -> Column:
    """Values of a window with parameters `own`, on the query's scale. Null parameters give null elements."""
    return F.transform(a, lambda v: (v - own["loc"]) / own["scale"] * query["scale"] + query["loc"])


def scale_invalid(p: Column, kind: str, eps: float) -> Column:
    """Whether a scale is too close to zero to divide by; never for raw."""
    return F.lit(False) if kind == "raw" else F.abs(p["scale"]) < eps


def l2_normalise(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))
    return let(norm, lambda n: F.transform(a, lambda v: F.try_divide(v, n)))


def squared_l2(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def clip_low(x: Column, low: float = 0.0) -> Column:
    """At least `low`; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
