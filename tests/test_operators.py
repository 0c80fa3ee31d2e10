import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import metrics as M
from gridloom.operators import diagnostics as D
from gridloom.operators import forecast as R
from gridloom.operators import fusion as U
from gridloom.operators import hierarchy as H
from gridloom.operators import retrieval as T
from gridloom.operators import scales as N
from gridloom.operators import windows as W
from tests.test_draws import plain_crossing, pool_adjacent


def one(df):
    return df.first()


def scalar(spark, schema, rows, *columns):
    return tuple(spark.createDataFrame(rows, schema).agg(*columns).first())


def test_metrics(spark):
    rows = [(3.0, 2.0), (1.0, 1.0), (4.0, 5.0)]
    got = scalar(spark, "y double, p double", rows, M.mae(F.col("y"), F.col("p")), M.wape(F.col("y"), F.col("p")))
    assert got == pytest.approx((2 / 3, 0.25))
    assert scalar(spark, "y double, p double", [(0.0, 1.0)], M.wape(F.col("y"), F.col("p"))) == (None,)
    assert scalar(spark, "y double, q double, l double", [(1.0, 0.0, 0.9), (0.0, 1.0, 0.9)], M.pinball(F.col("y"), F.col("q"), F.col("l")))[0] == pytest.approx(0.5)


def test_scaled_errors(spark):
    panel = spark.createDataFrame([(i, d, float(v)) for i, ys in {"a": [0, 0, 1, 2, 3], "b": [5, 5, 5], "c": [0, 0, 0], "d": [7]}.items() for d, v in enumerate(ys)], "id string, day_idx int, sales double")
    scales = H.naive_scales(panel, ["id"])
    assert {r.id: r.scale_sq for r in scales.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": None}
    scored = spark.createDataFrame([("a", 3.0, 2.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0)], "id string, y double, p double")
    out = {r.id: r for r in H.score_series(scored, scales, ["id"]).collect()}
    assert out["a"].mase == pytest.approx(0.5) and out["a"].rmsse == pytest.approx(math.sqrt(0.5)) and out["b"].rmsse is None


def test_scales(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 3.0],), ([-1.0, -3.0],)], "a array<double>")
    for kind, expected in {"mean": [1, 2, -2], "rms": [1, 5**0.5, 5**0.5], "znorm": [1, 1, 1], "raw": [1, 1, 1]}.items():
        assert [r[0].scale for r in df.select(A.scale_params(F.col("a"), kind)).collect()] == pytest.approx(expected)
    with pytest.raises(ValueError):
        A.scale_params(F.col("a"), "median")
    own, query = (F.struct(F.lit(0.0).alias("loc"), F.lit(s).alias("scale")) for s in (1.0, 3.0))
    assert one(df.limit(1).select(A.restore(F.array(*map(F.lit, (1.0, 2.0))), own, query)))[0] == [3.0, 6.0]
    assert one(df.limit(1).select(A.scale_invalid(F.struct(F.lit(0.003).alias("scale")), "mean", 0.01)))[0]
    rows = spark.createDataFrame([(1, 2.0, 4.0), (1, 0.0, 1.0), (2, 0.0, 1.0), (3, 1.0, -1.0)], "id int, u double, y double")
    assert {r.id: r.ls_scale for r in N.oracle_least_squares(rows, allow_oracle=True).collect()} == {1: 2.0, 2: 1.0, 3: 0.0}
    with pytest.raises(PermissionError):
        N.oracle_future_mean(rows)


def make(spark, seed=0, n=6, days=200, high=10):
    rng = np.random.default_rng(seed)
    ys = rng.integers(0, high, (n, days)).astype(float)
    return ys, spark.createDataFrame([(i, i % 2, [float(v) for v in y]) for i, y in enumerate(ys)], "id long, cat int, ys array<double>")


def brute(ys, train_end, context, horizon, stride, k, scale, cats):
    out = {}
    for q in range(len(ys)):
        qc = ys[q, train_end - context : train_end]
        ql, qs = T._params(qc[None], scale)
        found = []
        for s in range(len(ys)):
            if cats and s % 2 != q % 2:
                continue
            for t in range(context, train_end - horizon + 1, stride):
                if t + horizon < train_end + 1:
                    c = ys[s, t - context : t]
                    cl, cs = T._params(c[None], scale)
                    found.append((round(float((((c - cl) / cs - (qc - ql) / qs) ** 2).sum()), 9), s, t))
        out[q] = [(s, t) for _, s, t in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("scale,cats,high", [("mean", True, 10), ("znorm", False, 10), ("raw", True, 2), ("rms", False, 3)])
def test_both_forms_of_topk(spark, scale, cats, high):
    ys, series = make(spark, 3, high=high)
    expected = brute(ys, 150, 14, 7, 3, 9, scale, cats)
    queries = W.query_windows(series, 14, 150)
    key = (lambda df: F.col("cat")) if cats else None
    for block, part in ((2, 2), (100, 100)):
        found = T.topk_panel(queries, series, 9, 14, 7, 150, 3, scale, key=key, series_per_block=block, queries_per_block=part)
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.sid, r.t_r))
        assert got == expected
    built = T.topk(T.scaled_queries(queries, scale), T.scaled_candidates(W.window_database(series, 14, 7, 150, 3), scale), 4, on=["cat"] if cats else None, guard=F.col("t_r") + 7 < F.col("origin"))
    got = {}
    for r in built.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.sid, r.t_r))
    assert got == {q: v[:4] for q, v in expected.items()}


def test_retrieval_ignores_the_future(spark):
    ys, series = make(spark, 5)
    wrong = ys.copy()
    wrong[:, 150:] = 1e6
    spoiled = spark.createDataFrame([(i, i % 2, [float(v) for v in y]) for i, y in enumerate(wrong)], series.schema)
    run = lambda s: sorted(map(str, T.topk_panel(W.query_windows(s, 14, 150), s, 5, 14, 7, 150, 2, "mean").collect()))
    assert run(series) == run(spoiled)
    assert W.window_database(series, 14, 7, 20).count() == 0


def test_ties_go_to_earlier_candidates(spark):
    same = spark.createDataFrame([(i, [1.0] * 60) for i in range(4)], "id long, ys array<double>")
    rows = T.topk_panel(W.query_windows(same, 10, 50), same, 5, 10, 5, 50, 1, "mean").where("qid = 0").orderBy("rank").collect()
    assert [(r.sid, r.t_r) for r in rows] == [(0, t) for t in range(10, 15)]


def test_forecast_and_fallback(spark):
    _, series = make(spark, 1)
    queries = W.query_windows(series, 14, 150)
    empty = T.topk_panel(queries, series, 3, 14, 7, 20, 1, "mean")
    out = R.with_fallback(R.combine(R.restored_values(empty)), queries, 7)
    assert out.count() == 42 and out.where("not fallback").count() == 0
    summary = R.neighbour_summary(empty, R.combine(R.restored_values(empty)), queries).collect()
    assert {(r.nn_dist, r.disagreement) for r in summary} == {(1e6, 0.0)}
    back = R.run_backbone(queries, R.damped_drift(7)).collect()
    assert len(back) == 6 and all(len(r.point) == 7 and len(r.quantiles) == 7 for r in back)
    with pytest.raises(ValueError):
        R.covariate_inputs(series, 10, 5, "ys", ["ys"], ["price"])
    with pytest.raises(Exception, match="beyond the panel"):
        R.covariate_inputs(series, 199, 5, "ys", ["ys"], ["ys"]).collect()


def test_fusion(spark):
    df = spark.createDataFrame([(2.0, 0.0), (4.0, -20.0)], "c double, r double")
    assert [x[0] for x in df.select(U.fuse(F.col("c"), F.col("r"), 0.25)).collect()] == [1.5, 0.0]
    with pytest.raises(ValueError):
        U.fuse(F.col("c"), F.col("r"), 1.5)
    levels = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    q = F.array(*map(F.lit, [0.0, 0.0, 0.0, 0.0, 2.0, 3.0, 4.0]))
    values = one(df.limit(1).select(*(U.piecewise_cdf(q, levels, F.lit(x)) for x in (-1.0, 0.0, 1.0, 9.0))))
    assert tuple(values) == pytest.approx((0.05, 0.5, 0.625, 0.95))
    assert one(df.limit(1).select(U.monotone(F.array(*map(F.lit, [1.0, 3.0, 2.0])))))[0] == [1, 3, 3]
    laws = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])], "id long, backbone array<double>, retrieval array<double>")
    assert one(U.mixture_quantiles(laws, levels, 0.3)).mixture == pytest.approx([1, 2, 3, 4, 5, 6, 7])


def test_hierarchy_of_a_perfect_forecast(spark):
    rng = np.random.default_rng(0)
    rows = [(i, st, s, "D", "C", d, float(rng.integers(1, 9)), 1.0) for i in ("i1", "i2") for st, s in (("s1", "CA"), ("s2", "TX")) for d in range(1, 89)]
    panel = spark.createDataFrame(rows, "item string, store string, state string, dept string, cat string, day_idx int, sales double, sell_price double")
    perfect = panel.select("item", "store", "day_idx", F.col("sales").alias("p"))
    levels = H.wrmsse_levels(panel, perfect, 60)
    assert tuple(one(H.wrmsse(levels))) == (0.0, 12)
    assert {r.level: r.n_groups for r in levels.collect()}["item_store"] == 4


def test_diagnostics(spark):
    bins = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.35, 0.95, 1.0, 0.3)], "x double").select(D.bin_index(F.col("x"))).collect()
    assert [b[0] for b in bins] == [0, 0, 3, 9, 9, 3]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.5,)], "x double").select(D.bin_index(F.col("x"))).collect()
    rows = spark.createDataFrame([(1, h, float(h), 0.0, 2.0 * h + 1) for h in range(5)], "window int, h int, y double, c double, r double")
    assert all(abs(r.rescaled - r.y) < 1e-9 for r in D.oracle_rescale(rows).collect())
    assert one(D.optimal_weight(rows)).weight == pytest.approx(sum(h * (2 * h + 1) for h in range(5)) / sum((2 * h + 1) ** 2 for h in range(5)))
    assert pool_adjacent(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    rng = np.random.default_rng(1)
    x = rng.random(3000)
    u = np.where((x > 0.6) == (rng.random(3000) < 0.85), 1.0, -1.0)
    planted = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, u)], "x double, utility double")
    found = D.isotonic_crossing(planted, 50)
    assert abs(found["crossing"] - 0.6) < 0.05 and found["low"] <= found["crossing"] <= found["high"]
    assert D.isotonic_crossing(planted.limit(5)) is None
    rho = one(D.utility_correlates(planted, ["x"])).rho
    rx, ry = np.argsort(np.argsort(x)) + 1.0, np.where(u > 0, 0.5, -0.5)
    assert rho == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-9)
    # Student's t at its tabled points (the two-sided 5 % and 1 % points), and its closed forms for one and two degrees.
    for t, df, p in [(2.228139, 10, 0.05), (3.169273, 10, 0.01), (1.983972, 100, 0.05), (1.0, 1, 0.5), (2.0, 2, 1 - 2 / np.sqrt(6))]:
        pair = spark.createDataFrame([(-t / float(np.sqrt(df + t * t)), df + 2)], "rho double, n long")
        assert one(pair.select(D.correlation_p(F.col("rho"), F.col("n")).alias("p"))).p == pytest.approx(p, abs=1e-6)
    edges = spark.createDataFrame([(0.0, 9), (1.0, 9), (None, 9), (0.5, 2)], "rho double, n long")
    assert [r.p for r in edges.select(D.correlation_p(F.col("rho"), F.col("n")).alias("p")).collect()] == [1.0, pytest.approx(0, abs=1e-12), None, None]
    pairs = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (None, 2.0)], "a double, b double")
    out = one(D.bootstrap_mean_difference(pairs, "a", "b", 200))
    assert (out.n, out.mean) == (2, 1.5) and 1 <= out.low <= out.high <= 2
    many = spark.range(400).select(F.lit(0.0).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    got, values = one(D.bootstrap_mean_difference(many, "a", "b", 300)), np.arange(400) % 7
    exact = np.quantile([values[rng.integers(0, 400, 400)].mean() for _ in range(2000)], [0.025, 0.975])  # rows drawn with replacement
    assert got.mean == pytest.approx(values.mean()) and (got.low, got.high) == pytest.approx(tuple(exact), abs=0.06)


def test_crossing_lies_between_two_points():
    """The plain version that isotonic_crossing() is compared with in test_draws.py, against a plainer one: no crossing where the fit never is
    below one half or never reaches it; else by interpolation."""

    def plain(x, y):
        fit = list(map(float, y))
        for _ in range(len(fit)):  # pools neighbours until none falls
            for k in range(len(fit) - 1):
                if fit[k] > fit[k + 1] + 1e-15:
                    block = [i for i in range(len(fit)) if fit[i] in (fit[k], fit[k + 1])]
                    mean = sum(fit[i] for i in block) / len(block)
                    for i in block:
                        fit[i] = mean
        if fit[0] >= 0.5 or fit[-1] < 0.5:
            return None
        k = next(i for i, v in enumerate(fit) if v >= 0.5)
        return x[k - 1] + (0.5 - fit[k - 1]) / (fit[k] - fit[k - 1]) * (x[k] - x[k - 1])

    assert plain_crossing(np.arange(3.0), np.array([0.6, 0.7, 0.9]), np.ones(3)) is None
    assert plain_crossing(np.arange(3.0), np.array([0.1, 0.2, 0.3]), np.ones(3)) is None
    rng = np.random.default_rng(7)
    for _ in range(200):
        x = np.sort(rng.random(9))
        y = rng.random(9)
        got, expected = plain_crossing(x, y, np.ones(9)), plain(x, y)
        assert (got is None) == (expected is None) and (got is None or got == pytest.approx(expected))


def test_vectors_in_blocks(spark):
    from gridloom.operators.retrieval import topk_vectors

    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (120, 4)).astype(float)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id long, v array<double>")
    queries, pool = rows.select(F.col("id").alias("qid"), F.col("v").alias("vec")), rows.select(F.col("id").alias("cand_id"), F.col("v").alias("cvec"))
    for metric in ("sql2", "l2", "cosine"):
        got = sorted((r.qid, r.rank, r.cand_id) for r in topk_vectors(queries, pool, 3, metric, queries_per_block=50, vectors_per_block=17).collect())
        expected = []
        for i, q in enumerate(v):
            n = np.sqrt((v * v).sum(1))
            if metric == "cosine":
                known = [j for j in range(120) if n[j] and n[i]]
                d = {j: round(-float(q @ v[j]) / (n[i] * n[j]), 9) for j in known}
            else:
                d = {j: float(((q - v[j]) ** 2).sum()) for j in range(120)}
            expected += [(i, k + 1, j) for k, j in enumerate(sorted(d, key=lambda j: (d[j], j))[:3])]
        assert got == sorted(expected), metric


def test_small_helpers(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id long, y double")
    b = spark.createDataFrame([(1, 1.00001), (2, 2.5), (4, 1.0)], "id long, y double")
    assert tuple(one(D.alignment(a, b, ["id"], "y"))) == (4, 2)
    assert D.latency(10.0, 1.5, 8.0, 4.0) == {"backbone_ms": 15.0, "index_ms": 2.0, "total_ms": 17.0}
    with pytest.raises(ValueError):
        D.latency(1.0, 0.0, 1.0, 1.0)


def test_gate(spark):
    from gridloom.operators import models

    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.random(6)), 0) for i in range(300)]
    rows = [(*r[:-1], int(r[3] > 0.5)) for r in rows]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in models.GATE_FEATURES) + ", label int")
    gate = models.fit_gate(df, rounds=10, min_rows=5)
    assert models.gate_quality(gate, df)["accuracy"] > 0.95
    weights = models.gate_weight(gate, df)
    assert 0 < one(models.gate_summary(weights)).backbone_share < 1
    assert one(models.gate_weight(models.fit_gate(df.where("label = 1")), df)).weight == 1.0


def test_affine_probe(spark):
    from gridloom.operators.probe import run_grid

    rows = {(r.scale, r.gain, r.offset): r for r in run_grid(spark, (10.0,), (200.0,)).collect()}
    assert rows["znorm", 10.0, 200.0].hit_rate > 0.99 > 0.6 > rows["raw", 10.0, 200.0].hit_rate
