"""Forecasts from neighbours, and simple baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.arrays import array_mean, clip_low

LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
NO_NEIGHBOUR = 1e6


def restored_values(found: DataFrame, restored: bool = True, clip: bool = False, eps: float | None = None) -> DataFrame:
    """Rows (qid, rank, h, v) of the neighbours' continuations, on the query's scale if `restored`.

    clip: at least zero, before anything is averaged. eps: continuations of neighbours whose scale is smaller stay raw.
    """
    own = (F.col("v") - F.col("c_loc")) / F.col("c_scale") * F.col("q_scale") + F.col("q_loc")
    if eps is not None:
        own = F.when(F.abs("c_scale") < eps, F.col("v")).otherwise(own)
    rows = found.select("qid", "rank", "dist", "c_loc", "c_scale", "q_loc", "q_scale", F.posexplode("cont").alias("h0", "v"))
    value = own if restored else F.col("v")
    return rows.select("qid", "rank", (F.col("h0") + 1).alias("h"), (clip_low(value) if clip else value).alias("v"))


def combine(values: DataFrame, levels: tuple[float, ...] = LEVELS, clip_after: bool = False) -> DataFrame:
    """Per query and step: point (mean), quantiles (linear interpolation) and sd (population) over the neighbours."""
    out = values.groupBy("qid", "h").agg(
        F.avg("v").alias("point"), F.percentile("v", F.array(*map(F.lit, levels))).alias("quantiles"), F.stddev_pop("v").alias("sd")
    )
    if clip_after:
        out = out.withColumn("point", clip_low(F.col("point"))).withColumn("quantiles", F.transform("quantiles", clip_low))
    return out


def with_fallback(forecast: DataFrame, queries: DataFrame, horizon: int, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """One row a query and step; queries without neighbours get the mean of their context, at least zero, and a flag."""
    grid = queries.select("qid", array_mean(F.col("ctx")).alias("mean"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    mean = clip_low(F.col("mean"))
    return grid.join(forecast, ["qid", "h"], "left").select(
        "qid",
        "h",
        F.coalesce("point", mean).alias("point"),
        F.coalesce("quantiles", F.array_repeat(mean, len(levels))).alias("quantiles"),
        F.coalesce("sd", F.lit(0.0)).alias("sd"),
        F.col("point").isNull().alias("fallback"),
    )


def neighbour_summary(found: DataFrame, forecast: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: nn_dist (least distance, NO_NEIGHBOUR without any) and disagreement (mean over steps of the sd, else 0)."""
    near = found.groupBy("qid").agg(F.min("dist").alias("nn_dist"))
    spread = forecast.groupBy("qid").agg(F.avg("sd").alias("disagreement"))
    both = queries.select("qid").join(near, "qid", "left").join(spread, "qid", "left")
    return both.select("qid", F.coalesce("nn_dist", F.lit(NO_NEIGHBOUR)).alias("nn_dist"), F.coalesce("disagreement", F.lit(0.0)).alias("disagreement"))


def seasonal_naive(panel: DataFrame, train_end: int, horizon: int, season: int = 7) -> DataFrame:
    """(id, h, y_pred): the value of the last season's same phase; zero where there is none; at least zero."""
    last = panel.where(F.col("day_idx").between(train_end - season + 1, train_end)).select("id", (F.col("day_idx") - (train_end - season + 1)).alias("phase"), "sales")
    steps = panel.select("id").distinct().select("id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("phase", (F.col("h") - 1) % season)
    return steps.join(last, ["id", "phase"], "left").select("id", "h", clip_low(F.coalesce("sales", F.lit(0.0))).alias("y_pred"))


def recent_mean(panel: DataFrame, train_end: int, horizon: int, days: int = 56) -> DataFrame:
    """(id, h, y_pred): the mean of the last `days` days, repeated; at least zero."""
    means = panel.where((F.col("day_idx") > train_end - days) & (F.col("day_idx") <= train_end)).groupBy("id").agg(clip_low(F.avg("sales")).alias("y_pred"))
    return means.select("id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "y_pred")


def actuals(panel: DataFrame, train_end: int, horizon: int) -> DataFrame:
    return panel.where(F.col("day_idx").between(train_end + 1, train_end + horizon)).select("id", (F.col("day_idx") - train_end).alias("h"), F.col("sales").alias("y"))


Backbone = Callable[[pd.DataFrame], pd.DataFrame]


def damped_drift(horizon: int, levels: tuple[float, ...] = LEVELS) -> Backbone:
    """A deterministic stand-in for a forecasting model: exponential smoothing (0.2) with intervals of its own errors."""
    import numpy as np

    def predict(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ctx in rows["ctx"]:
            y = np.asarray(ctx, float)
            level, errors = y[0], []
            for v in y[1:]:
                errors.append(v - level)
                level += 0.2 * (v - level)
            spread = np.quantile(errors, levels) if errors else np.zeros(len(levels))
            out.append((np.maximum(np.full(horizon, level), 0).tolist(), np.maximum(level + spread, 0).tolist()))
        return pd.DataFrame({"qid": rows["qid"], "point": [p for p, _ in out], "quantiles": [q for _, q in out]})

    return predict


def run_backbone(queries: DataFrame, backbone: Backbone) -> DataFrame:
    """An external model over batches of queries (qid, ctx): qid, point (array over steps), quantiles (array over levels).

    A model that needs a GPU or weights is loaded once in each Python worker, inside `backbone`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield backbone(batch)

    return queries.select("qid", "ctx").mapInPandas(run, "qid long, point array<double>, quantiles array<double>")


def covariate_inputs(series: DataFrame, origin: int, horizon: int, target: str, past: list[str], future: list[str]) -> DataFrame:
    """Past arrays up to the origin and future arrays beyond it; future covariates must be among the past ones, and a
    horizon beyond the arrays raises when read."""
    if extra := sorted(set(future) - set(past)):
        raise ValueError(f"future covariates that aren't past ones: {', '.join(extra)}")
    fits = F.size(target) >= origin + horizon
    checked = series.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("the horizon lies beyond the panel")).cast("boolean")))
    columns = ["id", F.slice(target, 1, origin).alias("target")]
    columns += [F.slice(c, 1, origin).alias(f"past_{c}") for c in past] + [F.slice(c, origin + 1, horizon).alias(f"future_{c}") for c in future]
    return checked.select(columns)


def in_context_groups(found: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query its own context and those of its neighbours, by rank, padded on the left with nulls to its length."""
    length = F.size("qctx")
    padded = F.concat(F.array_repeat(F.lit(None).cast("double"), F.greatest(length - F.size("nctx"), F.lit(0))), "nctx")
    rows = found.join(queries.select("qid", F.col("ctx").alias("qctx")), "qid").join(candidates.select("sid", "t_r", F.col("ctx").alias("nctx")), ["sid", "t_r"])
    group = F.array_sort(F.collect_list(F.struct("rank", padded.alias("ctx"))))
    return rows.groupBy("qid").agg(F.first("qctx").alias("target"), F.transform(group, lambda x: x["ctx"]).alias("group"))
