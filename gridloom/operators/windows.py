"""Sliding windows: a context of L values up to day t_r, and the H values after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_database(series: DataFrame, context: int, horizon: int, train_end: int, stride: int = 1) -> DataFrame:
    """All windows with context <= t_r <= train_end - horizon, each stride-th: the columns of series but ys, and t_r, ctx,
    cont. Narrow: arrays are cut within the row. No row where no window fits."""
    last = F.least(F.lit(train_end), F.size("ys")) - horizon
    days = F.when(last >= context, F.sequence(F.lit(context), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    kept = [c for c in series.columns if c != "ys"]
    return series.select(*kept, "ys", F.explode(days).alias("t_r")).select(
        *kept,
        "t_r",
        F.slice("ys", F.col("t_r") - context + 1, context).alias("ctx"),
        F.slice("ys", F.col("t_r") + 1, horizon).alias("cont"),
    )


def query_windows(series: DataFrame, context: int, train_end: int) -> DataFrame:
    """The last `context` values up to train_end of each series, as qid and ctx; origin is the first day forecast."""
    kept = [c for c in series.columns if c not in ("ys", "id")]
    return series.where(F.size("ys") >= train_end).select(
        F.col("id").alias("qid"), *kept, F.slice("ys", train_end - context + 1, context).alias("ctx"), F.lit(train_end + 1).alias("origin")
    )


def legal(candidates: DataFrame, horizon: int, origin: int) -> DataFrame:
    """Those whose continuation ends before the origin (strictly)."""
    return candidates.where(F.col("t_r") + horizon < origin)
