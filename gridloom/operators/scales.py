"""Scales of a series from more than its own window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.arrays import array_mean


def degenerate(window: Column) -> Column:
    return array_mean(window) == 0


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def long_lookback(panel: DataFrame, train_end: int, lookback: int = 365) -> DataFrame:
    """Mean of the last `lookback` days; null if it isn't positive."""
    recent = panel.where((F.col("day_idx") > train_end - lookback) & (F.col("day_idx") <= train_end))
    return recent.groupBy("id").agg(_positive(F.avg("sales")).alias("scale"))


def hierarchy_prior(panel: DataFrame, train_end: int, group: list[str], lookback: int = 56) -> DataFrame:
    """For each id the mean of its whole group over the last `lookback` days; null if it isn't positive."""
    recent = panel.where((F.col("day_idx") > train_end - lookback) & (F.col("day_idx") <= train_end))
    means = recent.groupBy(*group).agg(_positive(F.avg("sales")).alias("scale"))
    return panel.select("id", *group).distinct().join(means, group, "left").select("id", "scale")


def _allowed(allow_oracle: bool) -> None:
    if not allow_oracle:
        raise PermissionError("this scale looks at the future; say allow_oracle=True in an analysis")


def oracle_future_mean(rows: DataFrame, allow_oracle: bool = False) -> DataFrame:
    """From (id, y): the mean of what is forecast; null if it isn't positive."""
    _allowed(allow_oracle)
    return rows.groupBy("id").agg(_positive(F.avg("y")).alias("mean_scale"))


def oracle_least_squares(rows: DataFrame, allow_oracle: bool = False) -> DataFrame:
    """From (id, u, y): the factor on u that fits y best. One for u of zeros, null with undefined values, at least zero."""
    _allowed(allow_oracle)
    uu, uy = F.sum(F.col("u") * F.col("u")), F.sum(F.col("u") * F.col("y"))
    undefined = F.count("*") != F.count(F.col("u") * F.col("y"))
    return rows.groupBy("id").agg(F.when(undefined, None).when(uu == 0, 1.0).otherwise(F.greatest(uy / F.when(uu != 0, uu), F.lit(0.0))).alias("ls_scale"))
