"""Error decomposition, profiles over bins, and what makes retrieval useful."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import metrics as M
from gridloom.functions.draws import poisson_counts, scrambled
from gridloom.sources.staging import discard, stage


def oracle_rescale(rows: DataFrame, value: str = "r", truth: str = "y") -> DataFrame:
    """Per window the least-squares line from value to truth, and the truth's mean where the value is constant: columns of
    rows and `rescaled`. It uses the truth, so it is a bound, not a forecast."""
    w = Window.partitionBy("window")
    var, cov = F.var_pop(value).over(w), F.covar_pop(value, truth).over(w)
    line = F.avg(truth).over(w) + cov / var * (F.col(value) - F.avg(value).over(w))
    return rows.withColumn("rescaled", F.when(var < 1e-12, F.avg(truth).over(w)).otherwise(line))


def optimal_weight(rows: DataFrame) -> DataFrame:
    """From (y, c, r): the weight on r that minimises the squared error of (1 - w) c + w r; null if r equals c."""
    gap = F.col("r") - F.col("c")
    total = F.sum(gap * gap)
    return rows.agg((-F.sum((F.col("c") - F.col("y")) * gap) / F.when(total >= 1e-30, total)).alias("weight"))


def decompose(rows: DataFrame, weight: float) -> DataFrame:
    """From (window, h, y, c, raw, r): mean over windows of the squared errors of the backbone c, raw and restored
    retrieval, their fusions, and the oracle-rescaled retrievals, and the shares derived from them."""
    sq = lambda x: F.avg((x - F.col("y")) * (x - F.col("y")))
    rescaled = oracle_rescale(oracle_rescale(rows, "raw").withColumnRenamed("rescaled", "raw_line"), "r").withColumnRenamed("rescaled", "line")
    mix = lambda c: (1 - weight) * F.col("c") + weight * F.col(c)
    per = rescaled.groupBy("window").agg(
        sq(F.col("c")).alias("backbone"), sq(F.col("raw")).alias("raw"), sq(F.col("r")).alias("restored"), sq(mix("r")).alias("fused"),
        sq(F.col("raw_line")).alias("raw_oracle"), sq(F.col("line")).alias("oracle"),
    )
    names = ["backbone", "raw", "restored", "fused", "raw_oracle", "oracle"]
    out = per.agg(F.count("*").alias("n_windows"), *(F.avg(c).alias(c) for c in names))
    return out.withColumn("removed_share", F.try_divide(F.col("raw") - F.col("restored"), F.col("raw") - F.col("raw_oracle"))).withColumn(
        "fusion_gain", F.try_divide(F.col("backbone") - F.col("fused"), F.col("backbone"))
    )


def bin_index(x: Column) -> Column:
    """The tenth that x of [0, 1] lies in, 0 to 9; null stays null, anything else raises."""
    inside = F.least(F.floor(x * 10 + 1e-12), F.lit(9)).cast("int")
    return F.when(x.isNull() | x.between(0.0, 1.0), inside).otherwise(F.raise_error(F.lit("outside of [0, 1]")).cast("int"))


def bin_summary(rows: DataFrame) -> DataFrame:
    """From (x, utility, delta, degenerate): per occupied tenth of x, rows, cohort sizes, win rates (strictly positive
    utility; a tie loses), mean and median delta; an empty cohort's figures are null."""
    ok = ~F.col("degenerate")
    win = (F.col("utility") > 0).cast("double")
    return rows.withColumn("bin", bin_index(F.col("x"))).groupBy("bin").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("degenerate")).alias("n_degenerate"),
        F.avg(win).alias("win_rate"),
        F.avg(F.when(ok, win)).alias("win_rate_regular"),
        F.avg(F.when(F.col("degenerate"), win)).alias("win_rate_degenerate"),
        F.avg("delta").alias("mean_delta"),
        F.expr("percentile(delta, 0.5)").alias("median_delta"),
    )


def decile_profile(rows: DataFrame) -> DataFrame:
    """From (x, utility): win rate and mean utility between consecutive deciles of x. The edges are one row."""
    edges = rows.agg(F.percentile("x", F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("edges"))
    decile = F.aggregate("edges", F.lit(0), lambda acc, e: acc + F.when(F.col("x") > e, 1).otherwise(0))
    return rows.join(F.broadcast(edges)).withColumn("decile", decile).groupBy("decile").agg(
        F.count("*").alias("n"), F.avg((F.col("utility") > 0).cast("double")).alias("win_rate"), F.avg("utility").alias("mean_utility")
    )


def origin_profile(rows: DataFrame) -> DataFrame:
    """From (origin, x, utility): per tenth of x, the mean over origins of the origin's mean, with its standard error
    (null for one origin)."""
    per = rows.withColumn("bin", bin_index(F.col("x"))).groupBy("bin", "origin").agg(F.avg("utility").alias("m"))
    return per.groupBy("bin").agg(
        F.count("*").alias("n_origins"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("sem")
    )


def routing_band(profile: DataFrame) -> DataFrame:
    """The range of bins whose mean lies clearly (1.96 standard errors) above zero, as edges in [0, 1]."""
    good = profile.where(F.col("mean") - 1.96 * F.col("sem") > 0)
    return good.agg((F.min("bin") / 10).alias("low"), ((F.max("bin") + 1) / 10).alias("high"), F.count("*").alias("n_bins"))


def sign_mismatch(found: DataFrame) -> DataFrame:
    """Share of retrieved pairs whose scales differ in sign, per rank."""
    return found.groupBy("rank").agg(F.avg((F.signum("c_scale") != F.signum("q_scale")).cast("double")).alias("mismatch"), F.count("*").alias("n"))


def constrained_best(grid: DataFrame, slack: float = 1.02) -> DataFrame:
    """Of configurations (name, k, w, mse, mae), the one of least mse among those whose mae is within `slack` of the best;
    ties by name, k, w."""
    limit = grid.agg(F.min("mae").alias("best"))
    return grid.join(F.broadcast(limit)).where(F.col("mae") <= slack * F.col("best")).orderBy("mse", "name", "k", "w").limit(1).drop("best")


#: So many distinct rows are drawn for at a time.
CHUNK = 1024


def _resampled(rows: DataFrame, columns: list[str], n_boot: int, seed: int) -> np.ndarray:
    """Means of the columns in each resample, one row each. Equal rows are counted first; a row that is there c times is drawn Poisson(c)
    times, by a generator that counts up from the row's values, so the same rows have the same resamples however they are partitioned.
    A task keeps one sum a resample and column."""
    cells = rows.groupBy(*columns).agg(F.count("*").alias("times")).withColumn("key", F.xxhash64(*columns))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_boot, 1 + len(columns)))
        for batch in batches:
            values = np.stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)], 1)
            keys, times = batch.column("key").to_numpy().view(np.uint64), batch.column("times").to_numpy()
            for at in range(0, batch.num_rows, CHUNK):
                part = slice(at, at + CHUNK)
                total += poisson_counts(keys[part], times[part], n_boot, seed).T @ values[part]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), *(pa.array(x) for x in total.T)], names=["k", "w", *(f"s{i}" for i in range(len(columns)))])

    names = ["w", *(f"s{i}" for i in range(len(columns)))]
    sums = cells.mapInArrow(add, "k long, " + ", ".join(f"{c} double" for c in names)).groupBy("k").agg(*(F.sum(c).alias(c) for c in names)).toArrow().sort_by("k")  # n_boot rows
    w, *found = (sums.column(c).to_numpy() for c in names)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.stack([np.where(w > 0, s / w, np.nan) for s in found], 1) if len(w) else np.full((n_boot, len(columns)), np.nan)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def bootstrap_mean_difference(rows: DataFrame, a: str, b: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Mean of b - a over rows where both are finite, with a percentile interval from n_boot resamples."""
    spark = rows.sparkSession
    both = [F.col(c).cast("double") for c in (a, b)]
    d = rows.where(_finite(both[0]) & _finite(both[1])).select((both[1] - both[0]).alias("d"))
    schema = "n long, mean double, low double, high double"
    n, mean = d.agg(F.count("*"), F.avg("d")).first()
    if n == 0:
        return spark.createDataFrame([], schema)
    means = _resampled(d, ["d"], n_boot, seed)[:, 0]
    low, high = np.quantile(means[np.isfinite(means)], [0.025, 0.975])
    return spark.createDataFrame([(n, float(mean), float(low), float(high))], schema)


def bootstrap_relative_improvement(rows: DataFrame, baseline: str, method: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(mean(baseline) - mean(method)) / mean(baseline) over rows where both are finite, with a percentile interval from
    resampling rows in pairs, as in bootstrap_mean_difference. Null where the baseline's mean is zero; such resamples count
    as null and leave the interval null too."""
    spark = rows.sparkSession
    b, m = F.col(baseline).cast("double"), F.col(method).cast("double")
    pairs = rows.where(_finite(b) & _finite(m)).select(b.alias("b"), m.alias("m"))
    schema = "n long, rel_improvement double, low double, high double, excludes_zero boolean"
    n, *whole = pairs.agg(F.count("*"), F.avg("b"), F.avg("m")).first()
    if n == 0:
        return spark.createDataFrame([], schema)
    means = _resampled(pairs, ["b", "m"], n_boot, seed)
    means = means[np.isfinite(means).all(1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios, point = (means[:, 0] - means[:, 1]) / means[:, 0], np.float64(whole[0] - whole[1]) / whole[0]
    known = lambda v: float(v) if np.isfinite(v) else None
    low, high = map(known, np.quantile(ratios, [0.025, 0.975]) if np.isfinite(ratios).all() else (np.nan, np.nan))
    return spark.createDataFrame([(n, known(point), low, high, None if low is None else low > 0 or high < 0)], schema)


def over_seeds(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation of a figure over runs, with their number."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(value).alias("n"))


def alignment(stored: DataFrame, built: DataFrame, keys: list[str], value: str, tolerance: float = 1e-4) -> DataFrame:
    """How many rows either side has (n), and in how many they differ or one is missing (n_off): one row."""
    both = stored.select(*keys, F.col(value).alias("a")).join(built.select(*keys, F.col(value).alias("b")), keys, "full")
    off = F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance * (1 + F.abs("b")), F.col("a").isNull() != F.col("b").isNull())
    return both.agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"))


def latency(backbone_ms: float, ratio: float, index_ms: float, speedup: float) -> dict[str, float]:
    """What a forecast costs: the backbone's time, times what was measured for its longer input, and the index's time, less
    by its speed-up."""
    if min(ratio, speedup) <= 0:
        raise ValueError("ratio and speedup must be positive")
    return {"backbone_ms": backbone_ms * ratio, "index_ms": index_ms / speedup, "total_ms": backbone_ms * ratio + index_ms / speedup}


def mean_ranks(rows: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """Distinct values of a column and the mean rank of their rows, from 1. Values are dealt over ranges, ranked within
    each, and shifted by the counts of the ranges before it, so no task orders all of them."""
    edges = rows.agg(F.percentile_approx(column, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    number = sum((F.when(F.col(column) > float(e), 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    counts = rows.groupBy(column).count().withColumn("bucket", number)
    sizes = counts.groupBy("bucket").agg(F.sum("count").alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of at most `buckets` rows
    below = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("below", below).join(F.broadcast(sizes.select("bucket", offset.alias("offset"))), "bucket")
    return placed.select(column, (F.col("offset") + F.col("below") + (F.col("count") + 1) / 2).alias(f"r{column}"))


#: Steps of Simpson's rule in correlation_p; even.
P_STEPS = 2000


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs under independence, that of Student's t with n - 2 degrees of freedom.
    With rho = sin(a) its density goes as cos(a) ** (n - 3), integrated by Simpson's rule as far as it is of any size.
    Null for a null correlation and for fewer than three pairs."""
    reach = F.least(F.lit(math.pi / 2), 12 / F.sqrt(n))

    def tail(start: Column) -> Column:
        width = F.least(reach, math.pi / 2 - start)
        weight = lambda i: F.when((i == 0) | (i == P_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        height = lambda i: F.pow(F.greatest(F.cos(start + width * i / P_STEPS), F.lit(0.0)), n - 3)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(P_STEPS)), F.lit(0.0), lambda acc, i: acc + weight(i) * height(i))
        return width / (3 * P_STEPS) * total

    return F.when((n >= 3) & rho.isNotNull(), F.least(tail(F.asin(F.least(F.abs(rho), F.lit(1.0)))) / tail(F.lit(0.0)), F.lit(1.0)))


def utility_correlates(rows: DataFrame, features: list[str], target: str = "utility") -> DataFrame:
    """Spearman's rank correlation of each feature with the target, with its two-sided p-value; both null for a constant
    column. Ties get their mean rank."""
    out = None
    for f in features:
        ranked = rows.select(F.col(f).cast("double").alias("x"), F.col(target).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
        ranked = ranked.join(mean_ranks(ranked, "x"), "x").join(mean_ranks(ranked, "y"), "y")
        one = ranked.agg(F.lit(f).alias("feature"), M.correlation("rx", "ry").alias("rho"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out.select("feature", "rho", correlation_p(F.col("rho"), F.col("n")).alias("p"), "n")


#: Ranges of x at most in the isotonic fit, values of x a range is meant to have, and values from which the ranges' edges are chosen.
RANGES, RANGE_SIZE, SAMPLE = 256, 2048, 4096


@dataclass(frozen=True)
class _Crossing:
    """Where the nondecreasing fit of P(win) passes one half, for the data and all resamples at once.

    The fit lies below one half for just the values of x up to the first at which the running sum of wins less losses is least. Its height
    there is the greatest mean of the wins over any stretch that ends there, and its height after it the least over any that begins
    there. Sums and minima of ranges of x add up, so each range is read twice, and the driver sees some figures a range and resample."""

    n_boot: int
    seed: int

    def drawn(self, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of a range in order of x: x, wins and numbers of rows, for the data (column 0) and the resamples."""
        table = table.sort_by("x")
        x, wins, n = (table.column(c).to_numpy() for c in ("x", "wins", "n"))
        keys = scrambled(x.view(np.uint64))
        for at in range(0, len(x), CHUNK):
            part = slice(at, at + CHUNK)
            won = np.column_stack([wins[part], poisson_counts(keys[part], wins[part], self.n_boot, self.seed)])
            lost = np.column_stack([n[part] - wins[part], poisson_counts(~keys[part], n[part] - wins[part], self.n_boot, self.seed)])
            yield x[part], won, won + lost

    def summary(self, table: pa.Table) -> pa.Table:
        """Of a range, for each resample: rows, wins and the first x with rows; the least running sum of wins less losses, with the rows, the
        wins and x up to there, and the first x with rows after it."""
        size = self.n_boot + 1
        rows, wins, least = np.zeros(size), np.zeros(size), np.full(size, np.inf)
        first, at, after = (np.full(size, np.nan) for _ in range(3))
        rows_at, wins_at = np.zeros(size), np.zeros(size)
        columns = np.arange(size)
        for x, won, n in self.drawn(table):
            w, c = rows + np.cumsum(n, 0), wins + np.cumsum(won, 0)
            there = n > 0
            some, start = there.any(0), x[there.argmax(0)]
            first = np.where(np.isnan(first) & some, start, first)
            after = np.where(np.isnan(after) & some, start, after)  # of a minimum before this chunk
            level = 2 * c - w
            k = level.argmin(0)
            lower = level[k, columns] < least
            later = there & (np.arange(len(x))[:, None] > k)
            following = np.where(later.any(0), x[later.argmax(0)], np.nan)
            least, at = np.where(lower, level[k, columns], least), np.where(lower, x[k], at)
            rows_at, wins_at = np.where(lower, w[k, columns], rows_at), np.where(lower, c[k, columns], wins_at)
            after = np.where(lower, following, after)
            rows, wins = w[-1], c[-1]
        names = ("rows", "wins", "first", "least", "at", "rows_at", "wins_at", "after")
        bucket = pa.array(np.full(size, table.column("bucket")[0].as_py()), pa.int32())
        return pa.table([bucket, pa.array(columns), *(pa.array(v) for v in (rows, wins, first, least, at, rows_at, wins_at, after))], names=["bucket", "k", *names])

    def heights(self, table: pa.Table, before: dict[int, np.ndarray], place: np.ndarray, rows_at: np.ndarray, wins_at: np.ndarray) -> pa.Table:
        """Of a range, for each resample: the greatest mean over a stretch from here to the place, and the least from after it to here.
        `before` has the rows and wins of the ranges before each."""
        rows, wins = before[table.column("bucket")[0].as_py()]
        low, high = np.full(len(place), -np.inf), np.full(len(place), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            for x, won, n in self.drawn(table):
                w, c = rows + np.cumsum(n, 0), wins + np.cumsum(won, 0)
                mean = (c - wins_at) / (w - rows_at)
                starts = np.vstack([rows, w[:-1]]), np.vstack([wins, c[:-1]])
                until = (wins_at - starts[1]) / (rows_at - starts[0])
                low = np.maximum(low, np.where((x[:, None] <= place) & (starts[0] < rows_at), until, -np.inf).max(0))
                high = np.minimum(high, np.where((x[:, None] > place) & (w > rows_at), mean, np.inf).min(0))
                rows, wins = w[-1], c[-1]
        return pa.table({"k": pa.array(np.arange(len(place))), "low": pa.array(low), "high": pa.array(high)})

    def found(self, cells: DataFrame) -> np.ndarray:
        """From cells (bucket, x, wins, n), the crossing for the data and each resample; not a number where the fit is nowhere below one half, or nowhere above."""
        size = self.n_boot + 1
        schema = "bucket int, k long, rows double, wins double, first double, least double, at double, rows_at double, wins_at double, after double"
        table = cells.groupBy("bucket").applyInArrow(lambda t: self.summary(t), schema).toArrow().sort_by([("bucket", "ascending"), ("k", "ascending")])  # RANGES * (n_boot + 1) rows at most
        buckets = table.column("bucket").to_numpy()[::size].tolist()
        of = {c: table.column(c).to_numpy().reshape(-1, size) for c in table.column_names[2:]}
        rows, wins = (np.vstack([np.zeros(size), np.cumsum(of[c], 0)[:-1]]) for c in ("rows", "wins"))
        level = 2 * wins - rows + of["least"]
        b, k = level.argmin(0), np.arange(size)
        place, rows_at, wins_at = of["at"][b, k], (rows + of["rows_at"])[b, k], (wins + of["wins_at"])[b, k]
        # The next x with rows: in the same range, or the first of a later one.
        following = np.full((len(buckets) + 1, size), np.nan)
        for i in range(len(buckets) - 1, -1, -1):
            following[i] = np.where(np.isnan(of["first"][i]), following[i + 1], of["first"][i])
        after = np.where(np.isnan(of["after"][b, k]), following[b + 1, k], of["after"][b, k])
        known = (level[b, k] < 0) & ~np.isnan(after)
        before = {bucket: np.stack([rows[i], wins[i]]) for i, bucket in enumerate(buckets)}
        heights = lambda t: self.heights(t, before, place, rows_at, wins_at)
        both = cells.groupBy("bucket").applyInArrow(heights, "k long, low double, high double").groupBy("k").agg(F.max("low").alias("low"), F.min("high").alias("high")).toArrow().sort_by("k")
        low, high = (both.column(c).to_numpy() for c in ("low", "high"))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(known, place + (0.5 - low) / (high - low) * (after - place), np.nan)


def _by_range(cells: DataFrame) -> DataFrame:
    """cells (x, wins, n) with `bucket`, a range of x: the edges come from a bounded sample of the values, drawn by hash."""
    ranges = min(RANGES, -(-cells.count() // RANGE_SIZE))
    sample = sorted(r["x"] for r in cells.select("x").orderBy(F.xxhash64("x")).limit(SAMPLE).collect())  # at most SAMPLE values
    edges = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)})
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("x"))) if edges else F.lit(0)
    return cells.withColumn("bucket", bucket.cast("int"))


def isotonic_crossing(rows: DataFrame, n_boot: int = 1000, seed: int = 0) -> dict | None:
    """From (x, utility): where the isotonic fit of P(utility > 0) first reaches one half, by interpolation (None if it doesn't), with a
    percentile interval if enough of n_boot resamples cross, and the share of wins and number of rows below and from the crossing on;
    without one, of the median. None for fewer than 20 rows. Rows without x or utility are left out.

    Exact for any number of distinct x: no binning, and no fit in one place."""
    cells = rows.where(_finite(F.col("x")) & F.col("utility").isNotNull()).select((F.col("x").cast("double") + 0.0).alias("x"), (F.col("utility") > 0).cast("long").alias("win"))
    cells = stage(cells.groupBy("x").agg(F.sum("win").alias("wins"), F.count("*").alias("n")), "crossing")
    n = cells.agg(F.sum("n")).first()[0] or 0
    if n < 20:
        discard(cells)
        return None
    point, *resamples = _Crossing(n_boot, seed).found(_by_range(cells))
    crossings = np.array(resamples)[np.isfinite(resamples)]
    low, high = np.quantile(crossings, [0.025, 0.975]) if len(crossings) >= max(20, n_boot // 10) else (None, None)
    point = float(point) if np.isfinite(point) else None
    split = F.lit(point) if point is not None else F.lit(cells.agg(F.percentile("x", F.lit(0.5), F.col("n"))).first()[0])
    below = F.col("x") < split
    total = lambda c, side: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0))
    sides = cells.agg(total("n", below).alias("n_below"), total("n", ~below).alias("n_above"), F.try_divide(total("wins", below), total("n", below)).alias("win_rate_below"), F.try_divide(total("wins", ~below), total("n", ~below)).alias("win_rate_above")).first()
    discard(cells)
    return {"crossing": point, "low": low, "high": high, "n": int(n)} | sides.asDict()


def band(rows: DataFrame, n_boot: int = 1000, seed: int = 0) -> dict | None:
    """Lower edge from the crossing over x and upper edge from that over -x, with their intervals, and the share of wins inside (both edges
    included) and outside. An edge that isn't reached is None; so is the upper one if it isn't above the lower. None for fewer than 20 rows."""
    lower = isotonic_crossing(rows, n_boot, seed)
    upper = isotonic_crossing(rows.withColumn("x", -F.col("x")), n_boot, seed + 1)
    if lower is None or upper is None:
        return None
    edge = None if upper["crossing"] is None else -upper["crossing"]
    if edge is not None and lower["crossing"] is not None and edge <= lower["crossing"]:
        edge = None
    interval = edge is not None and upper["low"] is not None
    inside = F.lit(True)
    if lower["crossing"] is not None:
        inside = inside & (F.col("x") >= lower["crossing"])
    if edge is not None:
        inside = inside & (F.col("x") <= edge)
    win = (F.col("utility") > 0).cast("double")
    sides = rows.where(_finite(F.col("x")) & F.col("utility").isNotNull()).agg(
        F.avg(F.when(inside, win)).alias("win_rate_inside"), F.avg(F.when(~inside, win)).alias("win_rate_outside"), F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside")
    )
    return {
        "low": lower["crossing"], "low_from": lower["low"], "low_to": lower["high"],
        "high": edge, "high_from": -upper["high"] if interval else None, "high_to": -upper["low"] if interval else None, "n": lower["n"],
    } | sides.first().asDict()


def spread_against_error(rows: DataFrame) -> DataFrame:
    """From (y, mu, sd): mean absolute error over mean sd; a Gaussian law has sqrt(2 / pi)."""
    return rows.agg(F.try_divide(F.avg(F.abs(F.col("y") - F.col("mu"))), F.avg("sd")).alias("ratio"), F.lit(float(np.sqrt(2 / np.pi))).alias("gaussian"))


def cohorts(panel: DataFrame, origins: list[int], context: int = 56) -> DataFrame:
    """Per (origin, id): zero_fraction of the context, degenerate (a context of zeros) and never_launched (no sale up to
    the origin). One pass over the panel; origins are a short list."""
    marks = F.explode(F.array(*map(F.lit, origins)))
    rows = panel.withColumn("origin", marks).where(F.col("day_idx") <= F.col("origin"))
    recent = F.col("day_idx") > F.col("origin") - context
    out = rows.groupBy("origin", "id").agg(
        F.avg(F.when(recent, (F.col("sales") == 0).cast("double"))).alias("zero_fraction"), F.max("sales").alias("top"), F.max(F.when(recent, F.col("sales"))).alias("recent_top")
    )
    return out.select("origin", "id", "zero_fraction", (F.col("recent_top") <= 0).alias("degenerate"), (F.col("top") <= 0).alias("never_launched"))


def identifiability(records: DataFrame, arms: list[str], base: str) -> DataFrame:
    """From per-(origin, id) errors of several arms: per tenth of zero_fraction, each arm's mean advantage over `base` on the
    rows where all are defined and the series has been launched, averaged over origins, with its standard error."""
    defined = ~F.col("never_launched")
    for a in [base, *arms]:
        defined = defined & F.col(a).isNotNull()
    rows = records.where(defined).withColumn("bin", bin_index(F.col("zero_fraction")))
    per = rows.groupBy("bin", "origin").agg(F.count("*").alias("n"), *(F.avg(F.col(base) - F.col(a)).alias(a) for a in arms))
    out = [F.sum("n").alias("n"), F.count("*").alias("n_origins")]
    for a in arms:
        out += [F.avg(a).alias(a), (F.stddev_samp(a) / F.sqrt(F.count("*"))).alias(f"{a}_sem")]
    return per.groupBy("bin").agg(*out)


def rule_profile(errors: DataFrame, x: DataFrame, rules: list[str]) -> DataFrame:
    """From (id, rule, error) of every scale rule and (id, x): per tenth of x, each rule's mean error and how often it is the
    best, on the ids that all rules have. Ties for the best count for each."""
    wide = errors.groupBy("id").pivot("rule", rules).agg(F.first("error")).dropna(subset=rules)
    best = F.least(*map(F.col, rules)) if len(rules) > 1 else F.col(rules[0])
    rows = wide.join(x, "id").withColumn("bin", bin_index(F.col("x")))
    aggs = [F.count("*").alias("n")]
    for r in rules:
        aggs += [F.avg(r).alias(f"{r}_error"), F.avg((F.col(r) == best).cast("double")).alias(f"{r}_best")]
    return rows.groupBy("bin").agg(*aggs)


def exemplar(nearest: DataFrame, future: DataFrame, min_log_ratio: float = 0.7) -> DataFrame:
    """Of the queries' first neighbours, the one whose continuation correlates best with the future although the scales
    differ by more than 2 ** min_log_ratio; only futures of above-median variance count. Ties in nine places go to the smaller qid."""
    steps = nearest.where("rank = 1").select("qid", "sid", "t_r", "c_scale", "q_scale", F.posexplode("cont").alias("h0", "v")).withColumn("h", F.col("h0") + 1)
    per = steps.join(future.select(F.col("id").alias("qid"), "h", "y"), ["qid", "h"]).groupBy("qid", "sid", "t_r", "c_scale", "q_scale").agg(M.correlation("v", "y").alias("shape"), F.var_pop("y").alias("variance"))
    median = per.agg(F.percentile("variance", F.lit(0.5)).alias("median"))
    ratio = F.abs(F.log2(F.try_divide("q_scale", "c_scale")))
    kept = per.join(F.broadcast(median)).where((F.col("variance") > F.col("median")) & (ratio > min_log_ratio) & F.col("shape").isNotNull() & ~F.isnan("shape"))  # one row
    return kept.select("qid", "sid", "t_r", "shape", ratio.alias("log_ratio")).orderBy(F.desc(F.round("shape", 9)), "qid").limit(1)


def closure(decomposed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Whether the gap from raw to its oracle is what restoration removes plus what remains."""
    gap, removed, left = F.col("raw") - F.col("raw_oracle"), F.col("raw") - F.col("restored"), F.col("restored") - F.col("raw_oracle")
    return decomposed.select(gap.alias("gap"), removed.alias("removed"), left.alias("remaining"), (F.abs(gap - removed - left) <= tolerance).alias("closes"))
