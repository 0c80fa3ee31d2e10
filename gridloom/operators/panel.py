"""Panels: long facts of (id, day_idx, value), dense grids and series arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """An input that doesn't have the columns or content that it must have."""


def require_columns(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{name} lacks {', '.join(missing)}")
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of `names`, under their new names: a view of another source in the words of this package."""
    if missing := sorted(set(names) - set(df.columns)):
        raise SchemaError(f"no column {', '.join(missing)}")
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items()))


def day_number(label: Column) -> Column:
    """The number of a label d_<n>, n from 1; anything else raises."""
    digits = F.regexp_extract(label, r"^d_(\d+)$", 1)
    n = F.when(digits != "", digits.cast("int"))
    return F.when(n >= 1, n).otherwise(F.raise_error(F.concat(F.lit("not a day label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def unpivot_days(wide: DataFrame, ids: list[str], value: str = "sales") -> DataFrame:
    """Wide d_1..d_n columns as rows (ids, d, value)."""
    days = [c for c in wide.columns if c.startswith("d_") and c[2:].isdigit()]
    if not days:
        raise SchemaError("no day columns")
    return wide.unpivot([F.col(c) for c in ids], [F.col(c) for c in days], "d", value)


def snap_of(state: Column, ca: Column, tx: Column, wi: Column) -> Column:
    """The flag of the row's state; any state but CA and TX takes the last."""
    return F.when(state == "CA", ca).when(state == "TX", tx).otherwise(wi).cast("byte")


def join_calendar_and_prices(sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Left joins on day_idx, then on store, item and week; a price is null where none is listed.

    Duplicate price keys would multiply rows, so they raise (one grouped count).
    """
    twice = prices.groupBy("store_id", "item_id", "wm_yr_wk").count().where("count > 1")
    if not twice.isEmpty():
        raise SchemaError("prices have several rows for a store, item and week")
    return sales.join(calendar, "day_idx", "left").join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")


def dense_grid(facts: DataFrame, first: int, last: int, value: str = "sales", fill: float = 0.0) -> DataFrame:
    """Every id on every day from first to last, with `fill` where no fact is. The days come from a generator, not a
    cross join; ids are the distinct ones of the facts."""
    ids = facts.select("id").distinct()
    grid = ids.select("id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day_idx"))
    inside = facts.where(F.col("day_idx").between(first, last)).select("id", "day_idx", value)
    return grid.join(inside, ["id", "day_idx"], "left").select("id", "day_idx", F.coalesce(F.col(value), F.lit(fill)).alias(value))


def series(panel: DataFrame, value: str = "sales") -> DataFrame:
    """One row an id with its values in order of day: (id, ys). The days are assumed dense; see require_dense."""
    ordered = F.array_sort(F.collect_list(F.struct("day_idx", F.col(value).alias("y"))))
    return panel.groupBy("id").agg(F.transform(ordered, lambda x: x["y"]).alias("ys"))


def series_from_facts(facts: DataFrame, first: int, last: int, value: str = "sales") -> DataFrame:
    """The same as series(dense_grid(...)) in one shuffle: gaps between sorted facts are filled within the array."""
    found = F.array_sort(F.collect_list(F.struct("day_idx", F.col(value).cast("double").alias("y"))))
    ends = F.concat(F.array(F.struct(F.lit(first - 1).alias("day_idx"), F.lit(0.0).alias("y"))), F.col("f"), F.array(F.struct(F.lit(last + 1).alias("day_idx"), F.lit(0.0).alias("y"))))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("e") - 1),
        lambda k: F.concat(
            F.array_repeat(F.lit(0.0), F.get("e", k)["day_idx"] - F.get("e", k - 1)["day_idx"] - 1),
            F.when(k < F.size("e") - 1, F.array(F.get("e", k)["y"])).otherwise(F.array().cast("array<double>")),
        ),
    )
    inside = facts.where(F.col("day_idx").between(first, last))
    return inside.groupBy("id").agg(found.alias("f")).withColumn("e", ends).select("id", F.flatten(pieces).alias("ys"))


def require_dense(panel: DataFrame, days: int) -> DataFrame:
    """panel, after checking that each id has `days` different days and no more rows."""
    bad = panel.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("day_idx").alias("d")).where((F.col("n") != days) | (F.col("d") != days))
    if not bad.isEmpty():
        raise SchemaError("the panel isn't dense")
    return panel


def select_series(facts: DataFrame, min_present: int) -> DataFrame:
    """Facts of the ids with at least min_present positive observations: chosen first, then a semi-join."""
    chosen = facts.groupBy("id").agg(F.count_if(F.col("sales") > 0).alias("present")).where(F.col("present") >= min_present)
    return facts.join(chosen.select("id"), "id", "left_semi")


def slices(panel: DataFrame, train_end: int) -> DataFrame:
    """Per id, membership of the report slices over the training days: mostly zero, low volume, few sales, regular."""
    per = panel.where(F.col("day_idx") <= train_end).groupBy("id").agg(
        F.avg((F.col("sales") == 0).cast("double")).alias("zero_fraction"), F.sum("sales").alias("volume"), F.count_if(F.col("sales") > 0).alias("n_positive")
    )
    median = per.agg(F.expr("percentile(volume, 0.5)").alias("median"))
    return per.join(F.broadcast(median)).select(  # one row
        "id",
        (F.col("zero_fraction") > 0.8).alias("intermittent"),
        (F.col("volume") < F.col("median")).alias("low_volume"),
        (F.col("n_positive") < 100).alias("short_history"),
        (F.col("zero_fraction") < 0.3).alias("regular"),
    )


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values, and the share of zeros of numeric ones. One pass over the table."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")}
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.count_distinct(c).alias(f"{c}|distinct")]
        aggs.append((F.avg((F.col(c) == 0).cast("double")) if c in numeric else F.lit(None).cast("double")).alias(f"{c}|zeros"))
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"`{c}|nulls`").alias("n_null"), F.col(f"`{c}|distinct`").alias("n_distinct"), F.round(F.col(f"`{c}|zeros`"), 6).alias("zero_share")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows equal an earlier one."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))
