"""Trained pieces: the gate between backbone and retrieval, and a tree baseline, by the boosted trees of this package."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.arrays import clip_low
from gridloom.functions.metrics import correlation
from gridloom.operators.boosting import Model, Settings, fit
from gridloom.operators.diagnostics import mean_ranks
from gridloom.operators.features import FEATURE_COLUMNS, training_rows
from gridloom.sources.staging import discard, stage

GATE_FEATURES = ("nn_dist", "disagreement", "zero_fraction", "log_volume", "quantile_width", "scale_spread")
GATE = Settings("logistic", rounds=200, leaves=15, rate=0.05, min_rows=50)
#: Sales of intermittent demand: Tweedie deviance; each tree sees four fifths of the rows and features.
BASELINE = Settings("tweedie", rounds=200, leaves=31, rate=0.05, min_rows=20, power=1.1, row_share=0.8, feature_share=0.8, seed=42)


def fit_gate(rows: DataFrame, features: tuple[str, ...] = GATE_FEATURES, rounds: int = 200, min_rows: int = 50) -> Model | float:
    """A classifier of label (1: retrieval is better) on gate features; with one label only, that label's constant."""
    rows = stage(rows.select("label", *features), "gate-rows")
    rates = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    found = float(rates["low"] or 0) if rates["low"] == rates["high"] else fit(rows, list(features), "label", replace(GATE, rounds=rounds, min_rows=min_rows))
    discard(rows)
    return found


def gate_weight(gate: Model | float, rows: DataFrame) -> DataFrame:
    """id and weight: the probability that retrieval is better. The gate may come from another panel: only its features' names count."""
    if isinstance(gate, float):
        return rows.select("id", F.lit(gate).alias("weight"))
    return gate.predict(rows, "weight").select("id", "weight")


def gate_quality(gate: Model | float, rows: DataFrame) -> dict[str, float | None]:
    """AUC (None with one label only), accuracy, Brier score and the majority's share on other rows (id, label, features)."""
    scored = rows.select("id", "label").join(gate_weight(gate, rows), "id").select(F.col("label").cast("double").alias("label"), F.col("weight").alias("p"))
    ranked = scored.join(mean_ranks(scored, "p"), "p")
    y, p = F.col("label"), F.col("p")
    one = ranked.agg(F.avg(((p >= 0.5).cast("double") == y).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("rate"), F.sum(y).alias("ones"), F.count("*").alias("n"), F.sum(F.when(y == 1, F.col("rp"))).alias("ranks")).first()
    pairs = (one["ones"] or 0) * (one["n"] - (one["ones"] or 0))
    auc = (one["ranks"] - one["ones"] * (one["ones"] + 1) / 2) / pairs if pairs else None
    return {"auc": auc, "accuracy": one["accuracy"], "brier": one["brier"], "majority": max(one["rate"], 1 - one["rate"]) if one["n"] else None}


def gate_summary(weights: DataFrame, features: DataFrame | None = None, names: tuple[str, ...] = GATE_FEATURES) -> DataFrame:
    """One row: mean and population deviation of the weights and the share below one half; with features (id, ...), also the correlation of
    the weight with each, null for a constant one."""
    figures = [F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("sd"), F.avg((F.col("weight") < 0.5).cast("double")).alias("backbone_share")]
    if features is None:
        return weights.agg(*figures)
    both = weights.select("id", "weight").join(features.select("id", *names), "id")
    return both.agg(*figures, *(correlation("weight", c).alias(f"corr_{c}") for c in names))


def ablations(train: DataFrame, test: DataFrame, features: tuple[str, ...] = GATE_FEATURES, rounds: int = 200, min_rows: int = 50) -> DataFrame:
    """How good the gate is on other rows with all features and without each: dropped (null for none), auc, accuracy, brier, majority. The
    rows are computed once; one gate is fitted for each feature."""
    spark = train.sparkSession
    train, test = stage(train.select("label", *features), "ablation-train"), stage(test.select("id", "label", *features), "ablation-test")
    out = []
    for dropped in (None, *features):
        kept = tuple(f for f in features if f != dropped)
        found = gate_quality(fit_gate(train, kept, rounds, min_rows), test)
        out.append((dropped, *(None if v is None else float(v) for v in found.values())))
    discard(train, test)
    return spark.createDataFrame(out, "dropped string, auc double, accuracy double, brier double, majority double")


def gbt_forecast(frame: DataFrame, train_end: int, horizon: int, rounds: int = 200, settings: Settings = BASELINE) -> DataFrame:
    """Direct forecast by boosted trees on the feature columns, fitted on days up to train_end whose lags are known; missing features are
    -1, forecasts at least zero."""
    train = training_rows(frame, train_end).select("sales", *FEATURE_COLUMNS)
    model = fit(train, list(FEATURE_COLUMNS), "sales", replace(settings, rounds=rounds))
    future = frame.where(F.col("day_idx").between(train_end + 1, train_end + horizon)).select("id", "day_idx", *FEATURE_COLUMNS)
    return model.predict(future).select("id", "day_idx", clip_low(F.col("prediction")).alias("y_pred"))
