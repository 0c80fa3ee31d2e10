"""Lag, rolling and price features, fitted on training days alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAGS = (28, 35, 42)
ROLLS = (7, 28)
FEATURE_COLUMNS = ("lag_28", "lag_35", "lag_42", "roll_mean_7", "roll_mean_28", "wday", "month", "year", "snap", "is_event", "price_norm", "series_train_mean")


def lag_features(panel: DataFrame, value: str = "sales") -> DataFrame:
    """lag_28, lag_35, lag_42 and means of the last 7 and 28 values of lag_28, null until the window is full."""
    by_day = Window.partitionBy("id").orderBy("day_idx")
    out = panel.select("*", *(F.lag(value, n).over(by_day).alias(f"lag_{n}") for n in LAGS))
    for n in ROLLS:
        w = by_day.rowsBetween(1 - n, 0)
        out = out.withColumn(f"roll_mean_{n}", F.when(F.count("lag_28").over(w) == n, F.avg("lag_28").over(w)))
    return out


def train_means(panel: DataFrame, train_end: int, key: str, value: str, name: str) -> DataFrame:
    """Mean of a value by key over days up to train_end."""
    return panel.where(F.col("day_idx") <= train_end).groupBy(key).agg(F.avg(value).alias(name))


def feature_frame(panel: DataFrame, train_end: int) -> DataFrame:
    """All features; price_norm is the price over the item's training mean, to six places (ties to even don't arise)."""
    items = train_means(panel, train_end, "item_id", "sell_price", "item_price_mean")
    means = train_means(panel, train_end, "id", "sales", "series_train_mean")
    return (
        lag_features(panel)
        .withColumn("is_event", F.col("event_name_1").isNotNull().cast("byte"))
        .join(items, "item_id", "left")
        .join(means, "id", "left")
        .withColumn("price_norm", F.round(F.try_divide("sell_price", "item_price_mean"), 6))
    )


def training_rows(features: DataFrame, train_end: int) -> DataFrame:
    return features.where((F.col("day_idx") <= train_end) & F.col("lag_28").isNotNull())


def covariates(frame: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """frame with missing texts as "none" and missing numbers as -1."""
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit("none")) for c in texts} | {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in numbers})
