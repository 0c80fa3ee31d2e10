"""Scale-free errors per series, and the weighted score over a 12-level hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import metrics as M
from gridloom.functions.metrics import scaled

#: The levels and the keys of their groups.
LEVELS = (
    ("total", ()),
    ("state", ("state",)),
    ("store", ("store",)),
    ("cat", ("cat",)),
    ("dept", ("dept",)),
    ("state_cat", ("state", "cat")),
    ("state_dept", ("state", "dept")),
    ("store_cat", ("store", "cat")),
    ("store_dept", ("store", "dept")),
    ("item", ("item",)),
    ("item_state", ("item", "state")),
    ("item_store", ("item", "store")),
)
KEYS = ("state", "store", "cat", "dept", "item")


def naive_scales(panel: DataFrame, by: list[str], season: int = 1, value: str = "sales", trim: bool = True) -> DataFrame:
    """Per group the mean absolute and squared difference to the value `season` days before, over the training days given.

    Leading zeros are left out (values must not be negative), unless all are zero. Null where no difference is left."""
    order = Window.partitionBy(*by).orderBy("day_idx")
    whole = Window.partitionBy(*by)
    rows = panel.withColumn("first", F.min(F.when(F.col(value) != 0, F.col("day_idx"))).over(whole))
    earlier = F.lag(value, season).over(order)
    rows = rows.withColumn("diff", F.col(value) - earlier).withColumn("from", F.lag("day_idx", season).over(order))
    used = F.col("first").isNull() | (F.col("from") >= F.col("first")) if trim else F.lit(True)
    diff = F.when(used, F.col("diff"))
    return rows.groupBy(*by).agg(F.avg(F.abs(diff)).alias("scale_abs"), F.avg(diff * diff).alias("scale_sq"))


def score_series(scored: DataFrame, scales: DataFrame, by: list[str]) -> DataFrame:
    """From (by, y, p) rows and naive_scales(): mae, mase and rmsse per group; null where undefined."""
    e = F.col("y") - F.col("p")
    errors = scored.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    joined = errors.join(scales, by, "left")
    return joined.select(*by, "mae", scaled(F.col("mae"), F.col("scale_abs")).alias("mase"), F.sqrt(scaled(F.col("mse"), F.col("scale_sq"))).alias("rmsse"))


def rollup(rows: DataFrame, sums: list[str], extra: list[str]) -> DataFrame:
    """Sums of the columns over all groups of all levels, per value of `extra` (day or step): level, key, extra, sums.

    One pass with grouping sets; a group's key is its key values joined by |."""
    sets = [[*keys, *extra] for _, keys in LEVELS]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *KEYS, *extra).agg(F.grouping_id(*KEYS, *extra).alias("gid"), *(F.sum(c).alias(c) for c in sums))
    level, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, keys in LEVELS:
        mask = sum(1 << (len(KEYS) + len(extra) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)
        level = F.when(F.col("gid") == mask, F.lit(name)).otherwise(level)
        key = F.when(F.col("gid") == mask, F.concat_ws("|", *keys) if keys else F.lit("all")).otherwise(key)
    return grouped.select(level.alias("level"), key.alias("key"), *extra, *sums)


def dollar_weights(panel: DataFrame, train_end: int, days: int = 28) -> DataFrame:
    """Revenue of each group over the last `days` training days; a missing price counts zero: level, key, weight. Summed as whole
    millionths, so the order of summation doesn't matter."""
    recent = panel.where((F.col("day_idx") > train_end - days) & (F.col("day_idx") <= train_end)).withColumn("weight", F.floor(F.col("sales") * F.coalesce("sell_price", F.lit(0.0)) * 1e6 + 0.5).cast("decimal(20, 0)"))
    return rollup(recent, ["weight"], []).withColumn("weight", F.col("weight").cast("double") / 1e6)


def wrmsse_levels(panel: DataFrame, forecast: DataFrame, train_end: int, horizon: int = 28) -> DataFrame:
    """Per level the weighted mean of the groups' RMSSE: level, wrmsse, n_groups.

    Sales are summed into groups first and scored then. Groups of undefined RMSSE lose their weight; a level of no weight is
    null. forecast has the panel's keys, day_idx and p."""
    history = rollup(panel.where(F.col("day_idx") <= train_end), ["sales"], ["day_idx"])
    future = panel.where(F.col("day_idx").between(train_end + 1, train_end + horizon)).withColumnRenamed("sales", "y")
    scored = rollup(future.join(forecast.select("item", "store", "day_idx", "p"), ["item", "store", "day_idx"], "left"), ["y", "p"], ["day_idx"])
    per_group = score_series(scored, naive_scales(history, ["level", "key"]), ["level", "key"]).join(dollar_weights(panel, train_end), ["level", "key"], "left")
    w = F.when(F.col("rmsse").isNotNull(), F.coalesce("weight", F.lit(0.0)))
    return per_group.groupBy("level").agg(F.try_divide(F.sum(w * F.col("rmsse")), F.when(F.sum(w) != 0, F.sum(w))).alias("wrmsse"), F.count("*").alias("n_groups"))


def wrmsse(levels: DataFrame) -> DataFrame:
    """The mean over the levels that are defined."""
    return levels.agg(F.avg("wrmsse").alias("wrmsse"), F.count("*").alias("n_levels"))


def level_bias(panel: DataFrame, forecast: DataFrame, train_end: int, horizon: int = 28) -> DataFrame:
    """Per level: signed error, signed and absolute error relative to the actual total."""
    future = panel.where(F.col("day_idx").between(train_end + 1, train_end + horizon)).withColumnRenamed("sales", "y")
    scored = rollup(future.join(forecast.select("item", "store", "day_idx", "p"), ["item", "store", "day_idx"], "left"), ["y", "p"], ["day_idx"])
    e = F.col("p") - F.col("y")
    return scored.groupBy("level").agg(
        F.sum(e).alias("bias"), F.try_divide(F.sum(e), F.sum("y")).alias("relative_bias"), F.try_divide(F.sum(F.abs(e)), F.sum(F.abs("y"))).alias("relative_error")
    )


def summary(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """From (method, id, y, y_pred) and the series' naive scales: per method MAE and WAPE over all rows, and the means over
    series of MASE and RMSSE where they are defined."""
    y, p = F.col("y"), F.col("y_pred")
    whole = rows.groupBy("method").agg(M.mae(y, p).alias("mae"), M.wape(y, p).alias("wape"))
    per = rows.groupBy("method", "id").agg(M.mae(y, p).alias("mae"), M.mse(y, p).alias("mse")).join(scales, "id", "left")
    scaled = per.groupBy("method").agg(F.avg(M.scaled(F.col("mae"), F.col("scale_abs"))).alias("mase"), F.avg(F.sqrt(M.scaled(F.col("mse"), F.col("scale_sq")))).alias("rmsse"))
    return whole.join(scaled, "method")
