"""Readers and writers: raw panel files, processed panels, reports, configuration and resumable runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions.draws import permuted, seeded
from gridloom.operators.panel import SchemaError, day_number, join_calendar_and_prices, require_columns, snap_of, unpivot_days

N_DAYS = 1941
#: The columns of the raw files.
CALENDAR = ("date", "wm_yr_wk", "weekday", "wday", "month", "year", "d", "event_name_1", "event_type_1", "event_name_2", "event_type_2", "snap_CA", "snap_TX", "snap_WI")
PRICES = ("store_id", "item_id", "wm_yr_wk", "sell_price")
ENTITY = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
FILES = ("calendar.csv", "sell_prices.csv", "sales_train_evaluation.csv")
INTEGERS = {"wm_yr_wk", "wday", "month", "year", "snap_CA", "snap_TX", "snap_WI"}


def _schema(columns: tuple[str, ...]) -> T.StructType:
    kind = lambda c: T.LongType() if c in INTEGERS else T.DoubleType() if c == "sell_price" else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv, .tsv, .json, .orc or .parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == "tsv" else ",")
    if suffix in ("json", "orc", "parquet"):
        return getattr(spark.read, suffix)(path)
    raise ValueError(f"unknown kind of file: {path}")


def read_raw(spark: SparkSession, raw: str, n_days: int = N_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """calendar, prices and wide sales, their columns checked by the header line before anything else is read."""
    frames = []
    for name, columns in ((FILES[0], CALENDAR), (FILES[1], PRICES), (FILES[2], (*ENTITY, f"d_{n_days}"))):
        path = f"{raw}/{name}"
        try:
            head = spark.read.csv(path, header=True)
        except Exception as e:
            raise SchemaError(f"{name} can't be read") from e
        require_columns(head, list(columns), name)
        if head.limit(1).isEmpty():
            raise SchemaError(f"{name} is empty")
        if name == FILES[2]:
            days = sorted(int(c[2:]) for c in head.columns if c.startswith("d_"))
            if days != list(range(1, n_days + 1)):
                raise SchemaError(f"the days are not 1 to {n_days}")
            schema = T.StructType([T.StructField(c, T.StringType() if c in ENTITY else T.IntegerType()) for c in head.columns])
        else:
            schema = T.StructType([_schema((c,)).fields[0] if c in columns else T.StructField(c, T.StringType()) for c in head.columns])
        frames.append(spark.read.csv(path, header=True, schema=schema))
    calendar, prices, sales = frames
    if prices.where(F.col("sell_price").isNotNull()).limit(1).isEmpty():
        raise SchemaError("no price is given")
    return calendar, prices, sales


def build_panel(calendar: DataFrame, prices: DataFrame, sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities (one row an id) and dynamic (one row an id and day)."""
    entities = sales.select(*ENTITY).dropDuplicates(["id"])
    rows = unpivot_days(sales, list(ENTITY)).withColumn("day_idx", day_number(F.col("d"))).withColumn("sales", F.col("sales").cast("int"))
    days = calendar.select(day_number(F.col("d")).alias("day_idx"), "date", "wm_yr_wk", "event_name_1", "event_type_1", "wday", "month", "year", "snap_CA", "snap_TX", "snap_WI")
    joined = join_calendar_and_prices(rows, F.broadcast(days), prices)  # one row a day of the calendar
    snap = snap_of(F.col("state_id"), F.col("snap_CA"), F.col("snap_TX"), F.col("snap_WI")).alias("snap")
    return entities, joined.select("id", "d", "day_idx", "date", "wm_yr_wk", "sales", "sell_price", snap, "event_name_1", "event_type_1", "wday", "month", "year")


def fingerprint(spark: SparkSession, raw: str, n_days: int) -> str:
    """SHA-256 over the digests of the three files, which executors compute, and the number of days."""
    rows = spark.read.format("binaryFile").load([f"{raw}/{f}" for f in FILES]).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")).collect()
    text = "|".join(f"{r['name']}:{r['digest']}" for r in sorted(rows)) + f"|{n_days}"
    return hashlib.sha256(text.encode()).hexdigest()


def ingest(spark: SparkSession, raw: str, processed: str, n_days: int = N_DAYS, force: bool = False) -> dict[str, Any]:
    """Writes entities and dynamic as Parquet, unless the inputs are those of the last time. Returns the metadata."""
    mark = fingerprint(spark, raw, n_days)
    meta = f"{processed}/meta"
    try:
        last = json.loads(spark.read.text(meta).first()[0])
        if last["fingerprint"] == mark and not force:
            return last | {"skipped": True}
    except Exception:  # nothing ingested yet
        pass
    entities, dynamic = build_panel(*read_raw(spark, raw, n_days))
    entities.write.mode("overwrite").parquet(f"{processed}/entities")
    dynamic.repartitionByRange("id").sortWithinPartitions("id", "day_idx").write.mode("overwrite").parquet(f"{processed}/dynamic")
    done = {"fingerprint": mark, "n_days": n_days}
    spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.mode("overwrite").text(meta)
    return done | {"skipped": False}


def load_processed(spark: SparkSession, processed: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{processed}/entities"), spark.read.parquet(f"{processed}/dynamic")


def ingest_sales_log(log: DataFrame, items: DataFrame, stores: DataFrame, first: str, last: str, min_present: int) -> tuple[DataFrame, DataFrame]:
    """A second kind of source: sales by (store_nbr, item_nbr, date) with gaps. Series with enough positive days are chosen
    first, then the log is reduced to them and spread over a dense calendar, zero where nothing was sold; returns
    (entities, dynamic). Returned goods (negative) count zero."""
    named = log.select(F.concat_ws("_", "store_nbr", "item_nbr").alias("id"), "store_nbr", "item_nbr", F.to_date("date").alias("date"), "unit_sales", "onpromotion")
    named = named.where(F.col("date").between(first, last))
    chosen = named.groupBy("id").agg(F.count_if(F.col("unit_sales") > 0).alias("n")).where(F.col("n") >= min_present).select("id")
    kept = named.join(chosen, "id", "left_semi")
    daily = kept.groupBy("id", "date").agg(F.sum(F.greatest("unit_sales", F.lit(0.0))).alias("sales"))
    grid = chosen.withColumn("date", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))))
    dynamic = grid.join(daily, ["id", "date"], "left").select("id", (F.datediff("date", F.lit(first)) + 1).alias("day_idx"), F.coalesce("sales", F.lit(0.0)).alias("sales"))
    one = kept.groupBy("id").agg(F.first("store_nbr").alias("store_nbr"), F.first("item_nbr").alias("item_nbr"), F.avg(F.coalesce(F.col("onpromotion").cast("double"), F.lit(0.0))).alias("promo_frac"))
    return one.join(items, "item_nbr", "left").join(stores, "store_nbr", "left"), dynamic


def load_multivariate(spark: SparkSession, path: str, train_end: int) -> DataFrame:
    """A CSV of a time column and numeric channels as (var, t, z), each channel standardised by its first train_end rows.

    Row order is the time column's."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    time, *channels = raw.columns
    rows = numbered(raw, [time], "t").withColumn("t", (F.col("t") + 1).cast("int"))
    rows = rows.unpivot([F.col("t")], [F.col(c).cast("double").alias(c) for c in channels], "var", "y")
    fit = rows.where(F.col("t") <= train_end).groupBy("var").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    return rows.join(F.broadcast(fit), "var").select("var", "t", ((F.col("y") - F.col("mean")) / F.when(F.col("sd") != 0, F.col("sd")).otherwise(1.0)).alias("z"))  # one row a channel


def generate_raw(dest: str, n_days: int = 120, seed: int = 0) -> None:
    """A small raw data set for tests: 2 states, 2 stores each, 2 departments, 3 items; lognormal means, Poisson sales of
    which three in ten are none; prices start up to three weeks late."""
    import csv
    from datetime import date, timedelta

    rng = np.random.default_rng(seed)
    Path(dest).mkdir(parents=True, exist_ok=True)
    day0 = date(2011, 1, 29)
    days = [day0 + timedelta(days=k) for k in range(n_days)]
    with open(f"{dest}/{FILES[0]}", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(CALENDAR)
        for k, d in enumerate(days):
            event = ["Fair", "Cultural"] if k % 30 == 17 else ["", ""]
            w.writerow([d.isoformat(), 11101 + k // 7, d.strftime("%A"), (d.weekday() + 2) % 7 + 1, d.month, d.year, f"d_{k + 1}", *event, "", "", *(int(k % 10 < 3 + i) for i in range(3))])
    ids = [(f"I{i}", f"D{g}", f"C{g}", f"{s}_{n}", s) for s in ("CA", "TX") for n in (1, 2) for g in (1, 2) for i in range(3 * g - 2, 3 * g + 1)]
    with open(f"{dest}/{FILES[1]}", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(PRICES)
        for item, _, _, store, _ in ids:
            for week in range(int(rng.integers(0, 4)), (n_days - 1) // 7 + 1):
                w.writerow([store, item, 11101 + week, round(float(rng.uniform(1, 9)), 2)])
    with open(f"{dest}/{FILES[2]}", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow([*ENTITY, *(f"d_{k + 1}" for k in range(n_days))])
        for item, dept, cat, store, state in ids:
            y = rng.poisson(rng.lognormal(0.5, 0.8), n_days) * (rng.random(n_days) > 0.3)
            w.writerow([f"{item}_{store}", item, dept, cat, store, state, *y.tolist()])


#: The histogram of draws has so many bins; that is what the driver sees of them.
DRAW_BITS = 16


def select_subset(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Rows of exactly n keys (all, if there are fewer) drawn without replacement: those of least seeded hash, ties by key. Rows of a null key
    are left out. The driver sees how many keys each range of hashes has; within the range of the n-th the keys are numbered."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("gridloom_draw", seeded(seed, F.col(key)))
    bin_of = F.shiftright("gridloom_draw", 60 - DRAW_BITS)
    left, cut = n, None
    for b, count in sorted((r[0], r[1]) for r in keys.groupBy(bin_of.alias("bin")).count().collect()):  # 2 ** DRAW_BITS at most
        if count > left:
            cut = b
            break
        left -= count
    if cut is not None:
        last = keys.where(bin_of == cut).withColumn("gridloom_rank", F.row_number().over(Window.partitionBy(F.lit(cut)).orderBy("gridloom_draw", key)))
        keys = keys.where(bin_of < cut).select(key).unionAll(last.where(F.col("gridloom_rank") <= left).select(key))
    return df.join(keys.select(key), key, "left_semi")


#: Ranges at most in numbered(), and rows from which their edges are chosen.
RANGES, SAMPLE = 256, 4096


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with each row's number from 0 in the order of some columns, nulls first; ties in any order. Rows are dealt into ranges, whose
    edges come from a bounded sample drawn by hash, counted, and numbered within their range: no task orders all of them."""
    sample = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(SAMPLE).orderBy(*order).collect()  # at most SAMPLE rows
    whole = lambda row: F.struct(*(F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order))
    edges = [whole(sample[k * len(sample) // RANGES]) for k in range(1, RANGES)] if len(sample) == SAMPLE else []
    own = F.struct(*order)
    found = df.withColumn("gridloom_range", F.size(F.filter(F.array(*edges), lambda e: e <= own)) if edges else F.lit(0))
    sizes = {r[0]: r[1] for r in found.groupBy("gridloom_range").count().collect()}  # at most RANGES
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), F.col("gridloom_range").cast("long")) if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("gridloom_range").orderBy(*order)) - 1
    return found.withColumn(name, (rank + offset).cast("long")).drop("gridloom_range")


def permutation_sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """Rows of the n keys (all, if there are fewer) that a seeded permutation of the sorted distinct keys puts first."""
    ranked = numbered(df.select(*keys).distinct(), keys, "gridloom_rank")
    total = F.lit(ranked.count()).cast("long")
    chosen = ranked.where(permuted(F.col("gridloom_rank"), total, seed) < n).select(*(F.col(c).alias(f"gridloom_{c}") for c in keys))
    same = [F.col(c).eqNullSafe(F.col(f"gridloom_{c}")) for c in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return df.join(chosen, condition, "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def finished(spark: SparkSession, path: str) -> set[int]:
    """The units that a resumable run has finished: those in its manifest, which is written after the unit's data."""
    manifest = f"{path}/_finished"
    return {int(r[0]) for r in spark.read.text(f"{manifest}/*").collect()} if _exists(spark, manifest) else set()  # a short list


def run_resumable(spark: SparkSession, path: str, origins: list[int], compute) -> list[int]:
    """compute(origin) -> DataFrame for each origin that isn't finished, each written to its own folder, in place of what an interrupted run may
    have left there, and entered in the manifest when it is whole. Returns those computed; read_resumable() reads those finished."""
    done = finished(spark, path)
    todo = [o for o in origins if o not in done]
    for o in todo:
        compute(o).write.mode("overwrite").parquet(f"{path}/origin={o}")
        spark.createDataFrame([(str(o),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_finished/{o}")
    return todo


def read_resumable(spark: SparkSession, path: str) -> DataFrame:
    """The finished units, with the column origin; ValueError if there is none."""
    if not (done := sorted(finished(spark, path))):
        raise ValueError(f"nothing is finished in {path}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/origin={o}" for o in done))


def write_report(report: dict[str, Any], path: str, title: str = "Report") -> None:
    """A JSON file, and beside it the same as Markdown. For small results of the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=1, sort_keys=True))
    lines = [f"# {title}", "", "| name | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in sorted(report.items()))]
    Path(path).with_suffix(".md").write_text("\n".join(lines) + "\n")


def environment(spark: SparkSession) -> dict[str, str]:
    import platform

    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


@dataclass(frozen=True)
class RunConfig:
    name: str
    processed_dir: str
    baseline: str = "seasonal_naive"
    split: str = "val"
    subset: int | None = None
    seeds: tuple[int, ...] = (0,)
    last_labeled_day: int = N_DAYS
    n_earlier_val: int = 2

    @classmethod
    def load(cls, path: str) -> RunConfig:
        """From YAML or JSON; unknown keys raise."""
        text = Path(path).read_text()
        if path.endswith(".json"):
            values = json.loads(text)
        else:
            import yaml

            values = yaml.safe_load(text)
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        if "seeds" in values:
            values["seeds"] = tuple(values["seeds"])
        return cls(**values)


def set_seed(seed: int) -> np.random.Generator:
    """Seeds Python's and NumPy's global generators and returns a generator of its own. Operators take their seed as a parameter."""
    import random

    random.seed(seed)
    np.random.seed(seed % 2**32)
    return np.random.default_rng(seed)


def require_declared(config: RunConfig, allow_full: bool = False, cap: int = 200) -> RunConfig:
    """Runs of more than `cap` series must be asked for."""
    if not allow_full and (config.subset is None or config.subset > cap):
        raise PermissionError(f"more than {cap} series: say allow_full=True")
    return config


def lock_once(path: str) -> None:
    """Marks a one-time evaluation as done; raises if it was."""
    try:
        Path(path).open("x").close()
    except FileExistsError as e:
        raise PermissionError(f"{path} exists: this evaluation has been used") from e
