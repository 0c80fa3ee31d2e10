"""Panels derived from the tables at hand, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.panel import dense_grid, series_from_facts
from gridloom.sources.staging import stage

#: The orders' days, all of them: the last is the same in every scale of the tables. STRIDE is that of a deployed pool.
DAYS, HORIZON, CONTEXT, STRIDE, K = 2500, 28, 56, 7, 20
TEST, VAL, VAL_M1, VAL_M2 = (DAYS - k * HORIZON for k in range(1, 5))
WEEKS = (DAYS - 1) // 7 + 1
WEEK_END = WEEKS - 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_of(column: str):
    return (F.datediff(F.to_date(column), F.lit("1995-01-01").cast("date")) + 1).cast("int")


def supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity sold by supplier and day."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), day_of("l_shipdate").alias("day_idx"), "l_quantity")
    return rows.where(F.col("day_idx").between(1, DAYS)).groupBy("id", "day_idx").agg(F.sum("l_quantity").alias("sales"))


def supplier_panel(spark: SparkSession, sf_dir: str, first: int = 1, last: int = DAYS) -> DataFrame:
    """All suppliers with a fact, on the days from first to last."""
    return dense_grid(supplier_facts(spark, sf_dir), first, last)


def recent_panel(spark: SparkSession, sf_dir: str, train_end: int) -> DataFrame:
    """The context before an origin and the horizon after it, written once for all that read it."""
    return stage(supplier_panel(spark, sf_dir, train_end - CONTEXT + 1, train_end + HORIZON), "recent-panel")


def supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, store (nation) and cat (region) of each supplier."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("store"), F.col("n_regionkey").alias("cat"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("store")).join(F.broadcast(nation), "store")  # 25 rows


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ys, store, cat: one row a supplier, without the dense grid ever being rows."""
    return series_from_facts(supplier_facts(spark, sf_dir), 1, DAYS).join(supplier_keys(spark, sf_dir), "id")


def mean_price(unit: Column) -> Column:
    """The mean of prices, summed as whole millionths: the same in any order of summation."""
    return F.sum(F.floor(unit * 1e6 + 0.5)) / F.lit(1e6) / F.count("*")


#: The same in SQL.
MEAN_PRICE = "CAST(SUM(CAST(floor(l_extendedprice / l_quantity * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / 1e6 / COUNT(*)"


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly quantity and mean price of a brand (item) in a supplier's nation (store), dense over WEEKS; day_idx is the
    week. dept and cat are the brand's number modulo ten and three."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("p_brand").alias("item"), F.col("n_name").alias("store"), F.col("r_name").alias("state"),
            (F.floor((day_of("l_shipdate") - 1) / 7) + 1).cast("int").alias("day_idx"), "l_quantity", "l_extendedprice",
        )
    )
    facts = rows.groupBy("item", "store", "state", "day_idx").agg(F.sum("l_quantity").alias("sales"), mean_price(F.col("l_extendedprice") / F.col("l_quantity")).alias("sell_price"))
    ids = facts.select("item", "store", "state").distinct()
    grid = ids.withColumn("day_idx", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))))
    number = F.regexp_extract("item", r"(\d+)$", 1).cast("int")
    return (
        grid.join(facts, ["item", "store", "state", "day_idx"], "left")
        .withColumn("sales", F.coalesce("sales", F.lit(0.0)))
        .withColumn("dept", F.concat(F.lit("D"), (number % 10).cast("string")))
        .withColumn("cat", F.concat(F.lit("C"), (number % 3).cast("string")))
    )


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles to six places: what both engines can agree on."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("byte", "short", "integer"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            d = c.cast("double")
            # Halves of the last place as they are in the product, like the SQL engine; round() goes by the shortest decimal.
            near = F.signum(d) * F.floor(F.abs(d) * 1e6 + 0.5) / 1e6
            c = F.when(F.abs(d) < 1e9, near).otherwise(F.round(d, 6)) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(out)


def sql(body: str, columns: str, *before: str) -> str:
    """A query over common table expressions, with the columns as tidy() has them: name:l, name:d, name:s or name:b."""
    chosen = []
    for spec in columns.split():
        name, kind = spec.split(":")
        cast = {"l": f"CAST({name} AS BIGINT)", "d": f"ROUND(CAST({name} AS DOUBLE), 6) + 0.0", "s": f"CAST({name} AS VARCHAR)", "b": f"CAST({name} AS BOOLEAN)"}[kind]
        chosen.append(f"{cast} AS {name}")
    with_ = ("WITH " + ",\n".join(before) + "\n") if before else ""
    return f"{with_}SELECT {', '.join(chosen)} FROM (\n{body}\n) result"


FACT = f"""fact AS (SELECT * FROM (SELECT l_suppkey AS id, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 AS day_idx, SUM(l_quantity) AS sales
  FROM lineitem GROUP BY 1, 2) WHERE day_idx BETWEEN 1 AND {DAYS})"""
PANEL = f"""panel AS (SELECT i.id, d.day_idx, COALESCE(f.sales, 0.0) AS sales FROM (SELECT DISTINCT id FROM fact) i
  CROSS JOIN (SELECT range AS day_idx FROM range(1, {DAYS + 1})) d LEFT JOIN fact f ON f.id = i.id AND f.day_idx = d.day_idx)"""
SERIES = """series AS (SELECT p.id, list(p.sales ORDER BY p.day_idx) AS ys, any_value(s.s_nationkey) AS store, any_value(n.n_regionkey) AS cat
  FROM panel p JOIN supplier s ON s.s_suppkey = p.id JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY p.id)"""
BASE = (FACT, PANEL, SERIES)


def windows_sql(train_end: int = VAL, context: int = CONTEXT, horizon: int = HORIZON, stride: int = STRIDE) -> str:
    return f"""win AS (SELECT id AS sid, cat, store, t_r, ys[t_r - {context} + 1 : t_r] AS ctx, ys[t_r + 1 : t_r + {horizon}] AS cont
  FROM series, (SELECT CAST(range AS INT) AS t_r FROM range({context}, {train_end - horizon + 1}, {stride})))"""


def queries_sql(train_end: int = VAL, context: int = CONTEXT) -> str:
    return f"""q AS (SELECT id AS qid, cat, store, {train_end + 1} AS origin, ys[{train_end - context + 1} : {train_end}] AS ctx FROM series)"""


def params_sql(scale: str, a: str = "ctx") -> tuple[str, str]:
    """SQL for loc and scale of a list."""
    mean = f"(list_sum({a}) / len({a}))"
    one = lambda x: f"(CASE WHEN {x} = 0 THEN 1.0 ELSE {x} END)"
    if scale == "raw":
        return "0.0", "1.0"
    if scale == "mean":
        return "0.0", one(mean)
    if scale == "rms":
        return "0.0", one(f"sqrt(list_sum(list_transform({a}, lambda v: v * v)) / len({a}))")
    return mean, one(f"sqrt(list_sum(list_transform({a}, lambda v: (v - {mean}) * (v - {mean}))) / len({a}))")


def topk_sql(scale: str, k: int = K, on: str = "c.cat = q.cat", extra: str = "TRUE", horizon: int = HORIZON) -> tuple[str, ...]:
    """CTEs cw, qw and top: qid, rank, dist, sid, t_r, cont and both sides' parameters."""
    loc, s = params_sql(scale)
    return (
        f"cp AS (SELECT *, {loc} AS c_loc, {s} AS c_scale FROM win)",
        "cw AS (SELECT *, list_transform(ctx, lambda v: (v - c_loc) / c_scale) AS cvec FROM cp)",
        f"qp AS (SELECT *, {loc} AS q_loc, {s} AS q_scale FROM q)",
        "qw AS (SELECT *, list_transform(ctx, lambda v: (v - q_loc) / q_scale) AS vec FROM qp)",
        f"""pairs AS (SELECT q.qid, q.origin, c.sid, c.t_r, c.cont, c.c_loc, c.c_scale, q.q_loc, q.q_scale,
  ROUND(list_sum(list_transform(list_zip(q.vec, c.cvec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS dist
  FROM qw q JOIN cw c ON {on} AND c.t_r + {horizon} < q.origin AND {extra})""",
        f"top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, sid, t_r) AS rank FROM pairs QUALIFY rank <= {k})",
    )


MARKET = (
    f"""mfact AS (SELECT p_brand AS item, n_name AS store, r_name AS state, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7) AS INT) + 1 AS day_idx,
  SUM(l_quantity) AS sales, {MEAN_PRICE} AS sell_price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)""",
    f"""market AS (SELECT i.item, i.store, i.state, d.day_idx, COALESCE(f.sales, 0.0) AS sales, f.sell_price,
  'D' || (CAST(regexp_extract(i.item, '(\\d+)$', 1) AS INT) % 10) AS dept, 'C' || (CAST(regexp_extract(i.item, '(\\d+)$', 1) AS INT) % 3) AS cat
  FROM (SELECT DISTINCT item, store, state FROM mfact) i CROSS JOIN (SELECT CAST(range AS INT) AS day_idx FROM range(1, {WEEKS + 1})) d
  LEFT JOIN mfact f ON f.item = i.item AND f.store = i.store AND f.state = i.state AND f.day_idx = d.day_idx)""",
)
