"""The search step: equal series and queries once, few differences, and nothing searched twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import diagnostics as D
from gridloom.operators import retrieval as T
from gridloom.operators import windows as W
from tests.test_operators import brute


def test_equal_series_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    few = rng.integers(0, 3, (5, 120)).astype(float)
    ys = few[rng.integers(0, 5, 40)]
    series = spark.createDataFrame([(i, i % 2, [float(v) for v in y]) for i, y in enumerate(ys)], "id long, cat int, ys array<double>")
    staged, whole = {}, T.stage
    monkeypatch.setattr(T, "stage", lambda df, name: staged.setdefault(name, whole(df, name)))
    found = T.topk_panel(W.query_windows(series, 14, 100), series, 9, 14, 7, 100, 3, "mean", key=lambda df: F.col("cat"))
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.sid, r.t_r))
        assert r.cont == ys[r.sid, r.t_r : r.t_r + 7].tolist()
    assert got == brute(ys, 100, 14, 7, 3, 9, "mean", True)
    assert staged["search-series"].count() == len({(i % 2, *y) for i, y in enumerate(ys)}) <= 10


@pytest.mark.parametrize("seed", range(4))
def test_nearest_is_exact(monkeypatch, seed):
    monkeypatch.setattr(T._Nearest, "QUERIES", 7)
    monkeypatch.setattr(T._Nearest, "CANDIDATES", 50)
    monkeypatch.setattr(T._Nearest, "PAIRS", 30)
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 2 + seed, (400, 6)) * 10.0 ** rng.integers(-3, 8 if seed % 2 else 1, (400, 1))
    q = np.concatenate([c[:20] + 1e-4, rng.integers(0, 3, (13, 6)).astype(float)])
    legal = rng.random((len(q), len(c))) < 0.5
    nearest = T._Nearest(q, 8)
    for at in (0, 130):
        part = slice(at, 130 if at == 0 else None)
        nearest.add(c[part], lambda rows, cols, part=part: legal[:, part][rows, cols])
    d = np.round(((q[:, None] - c[None]) ** 2).sum(2), 9)
    d[~legal] = np.inf
    expected = np.argsort(d, axis=1, kind="stable")[:, :8]
    assert nearest.places.tolist() == expected.tolist()
    assert nearest.dist.tolist() == np.take_along_axis(d, expected, 1).tolist()


def test_nearest_with_many_for_one_query_and_numbers_out_of_range():
    """A query that most candidates are near to, beside some that few are, and distances that are infinite or not a number."""
    rng = np.random.default_rng(8)
    c = np.concatenate([rng.integers(0, 3, (60, 4)), np.full((2, 4), 1e200), np.full((2, 4), np.nan), rng.integers(0, 3, (60, 4))])
    q = np.array([[1.0] * 4, [90.0, 0, 0, 0], [1e200] * 4, [0.0] * 4])
    for legal in (np.ones((4, len(c)), bool), rng.random((4, len(c))) < 0.04):
        nearest = T._Nearest(q, 7)
        for part in (slice(0, 61), slice(61, 90), slice(90, None)):
            nearest.add(c[part], lambda rows, cols, part=part, legal=legal: legal[:, part][rows, cols])
        with np.errstate(over="ignore"):
            d = np.round(((q[:, None] - c[None]) ** 2).sum(2), 9)
        for i in range(4):
            order = sorted(np.flatnonzero(legal[i]), key=lambda j: (np.isnan(d[i, j]), d[i, j] if d[i, j] == d[i, j] else 0.0, j))[:7]
            assert nearest.places[i].tolist() == order + [-1] * (7 - len(order))


def test_exemplar_with_constant_continuations(spark):
    cont = [[0.0, 0.0, 0.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0], [3.0, 1.0, 1.0], [2.0, 1.0, 1.0]]
    future = [[1.0, 9.0, 2.0], [2.0, 4.0, 8.0], [2.0, 4.0, 8.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    nearest = spark.createDataFrame([(i, 7, 50, 1.0, 9.0, c, 1) for i, c in enumerate(cont)], "qid long, sid long, t_r int, c_scale double, q_scale double, cont array<double>, rank int")
    steps = spark.createDataFrame([(i, h + 1, y) for i, ys in enumerate(future) for h, y in enumerate(ys)], "id long, h int, y double")
    row = D.exemplar(nearest.union(nearest.withColumn("qid", F.col("qid") + 5)), steps.union(steps.withColumn("id", F.col("id") + 5))).first()
    assert row.qid == 1 and row["shape"] == pytest.approx(1.0)
    rows = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, utility double")
    found = D.utility_correlates(rows, ["x"]).first()
    assert found.rho is None and found.p is None and found.n == 5


def test_vectors_within_a_key(spark):
    rng = np.random.default_rng(6)
    v, labels = rng.integers(-2, 3, (90, 4)).astype(float), rng.integers(0, 4, 90)
    rows = spark.createDataFrame([(i, int(x), [float(a) for a in y]) for i, (x, y) in enumerate(zip(labels, v))] + [(500, None, [0.0] * 4)], "id long, label int, v array<double>")
    found = T.topk_vectors(rows.select(F.col("id").alias("qid"), "label", F.col("v").alias("vec")), rows.select(F.col("id").alias("cand_id"), "label", F.col("v").alias("cvec")), 3, "sql2", queries_per_block=7, vectors_per_block=9, on="label")
    expected = []
    for i, q in enumerate(v):
        near = sorted((float(((q - v[j]) ** 2).sum()), j) for j in range(90) if labels[j] == labels[i])[:3]
        expected += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    assert sorted((r.qid, r["rank"], r.cand_id, r.dist) for r in found.collect()) == sorted(expected)


def test_builtin_join_without_a_loop(spark):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, i % 3, [float(a) for a in rng.random(5)]) for i in range(60)], "id long, label int, v array<double>")
    queries, pool = rows.select(F.col("id").alias("qid"), "label", F.col("v").alias("vec")), rows.select(F.col("id").alias("cand_id"), "label", F.col("v").alias("cvec"))
    plain, compiled = (sorted(map(tuple, T.topk(queries, pool, 4, on=["label"], **more).select("qid", "cand_id", "dist", "rank").collect())) for more in ({}, {"length": 5}))
    assert plain == compiled and len(plain) == 240


def test_probe_searches_once_a_scale(spark, monkeypatch):
    from gridloom.operators import probe

    scales, whole = [], probe.topk_panel
    monkeypatch.setattr(probe, "topk_panel", lambda *args: scales.append(args[-1]) or whole(*args))
    rng = np.random.default_rng(8)
    series = spark.createDataFrame([(i, [float(v) for v in rng.integers(0, 5, 60)]) for i in range(4)], "id long, ys array<double>")
    rows = probe.planted_grid(series, 12, 4, 24, 50, 3, (1.0, 2.0), (0.0,), n_boot=20).collect()
    assert sorted(scales) == ["mean", "raw", "rms", "znorm"] and len(rows) == 10


def test_equal_vectors_are_dealt_once(spark):
    rng = np.random.default_rng(9)
    few = rng.integers(0, 4, (30, 6)).astype(float)
    rows = [(i, t, [float(v) for v in few[(i % 3) * 10 + t]]) for i in range(45) for t in range(10)]
    candidates = spark.createDataFrame(rows, "id long, t_r int, cvec array<double>")
    asked = [(i, 9, [float(v) for v in few[i % 4]]) for i in range(12)]
    index = T.PrunedSearch(candidates, 1, 3, most=5)
    found = index.search(spark.createDataFrame(asked, "qid long, origin int, vec array<double>"), 5).collect()
    expected = [(q, r + 1, *x[1:]) for q, _, v in asked for r, x in enumerate(sorted((float(((np.array(c) - v) ** 2).sum()), i, t) for i, t, c in rows if t + 1 < 9)[:5])]
    assert sorted((r.qid, r["rank"], r.sid, r.t_r) for r in found) == sorted(expected)
    assert index.given == 450 and index.candidates.count() == 30
    computed = {r.qid: r.n for r in index.computed.collect()}
    assert set(computed) == set(range(12)) and all(computed[q] == 0 for q in range(4, 12)) and sum(computed.values()) <= 4 * 30


def test_blocks_send_no_continuations(spark, monkeypatch):
    ranked, whole = [], T.rank_within
    monkeypatch.setattr(T, "rank_within", lambda df, *args: ranked.append(df.columns) or whole(df, *args))
    monkeypatch.setattr(T, "SERIES_A_GROUP", 7)
    ys = np.random.default_rng(12).integers(0, 4, (40, 120)).astype(float)
    series = spark.createDataFrame([(i, i % 2, [float(v) for v in y]) for i, y in enumerate(ys)], "id long, cat int, ys array<double>")
    got = {}
    for r in T.topk_panel(W.query_windows(series, 14, 100), series, 6, 14, 7, 100, 3, "mean", key=lambda df: F.col("cat")).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.sid, r.t_r))
        assert r.cont == ys[r.sid, r.t_r : r.t_r + 7].tolist()
    assert got == brute(ys, 100, 14, 7, 3, 6, "mean", True)
    assert ranked and not any("cont" in columns for columns in ranked)


def test_set_places():
    for shape in ((3, 5), (4, 16), (1, 7), (0, 8)):
        ok = np.random.default_rng(sum(shape)).random(shape) < 0.2
        assert [x.tolist() for x in T._set(ok)] == [x.tolist() for x in np.nonzero(ok)]


def test_gate_searches_an_origin_once(spark, monkeypatch):
    from gridloom.operators import models
    from gridloom.plans.queries import QUERIES
    from tests.conftest import SF

    searched, whole = [], T.topk_panel
    monkeypatch.setattr(T, "topk_panel", lambda *args, **named: searched.append(args[5]) or whole(*args, **named))
    monkeypatch.setattr(models, "fit_gate", lambda rows: 0.5)
    QUERIES["gated_fusion"](spark, SF)
    assert len(searched) == len(set(searched)) == 3


def test_rules_share_their_series(spark, monkeypatch):
    from gridloom.plans import queries
    from tests.conftest import SF

    staged, whole = [], queries.stage
    monkeypatch.setattr(queries, "stage", lambda df, name: staged.append(name) or whole(df, name))
    queries.QUERIES["scale_rule_profile"](spark, SF)
    assert staged.count("series") == 1


def test_random_choice_builds_series_once(spark):
    """The series, the queries and the permutation are computed once, not by each sum and condition that names them."""
    counts = {"series": spark.sparkContext.accumulator(0), "queries": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        seen = counts[name]

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    rows = spark.createDataFrame([(i, i % 2, [1.0] * 40) for i in range(12)], "id long, store int, ys array<double>")
    series = counted(rows, "series")
    queries = counted(rows.selectExpr("id AS qid", "store", "40 AS origin"), "queries")
    found = T.random_choice(queries, series, 3, 8, 4, 40, 4, 7, ["store"])
    assert found.count() == 36 and "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {name: n.value for name, n in counts.items()} == {"series": 12, "queries": 12}


def test_nearest_leaves_most_rows_after_the_product(monkeypatch):
    """Later candidates seldom pass, so for most queries no matrix of what passes is made; ties go by the order given, not by length."""
    seen, whole = [], T._Nearest._possible
    monkeypatch.setattr(T._Nearest, "_possible", lambda self, q, *args: (lambda found: seen.append((len(q), len(found[-1]))) or found)(whole(self, q, *args)))
    rng = np.random.default_rng(9)
    q, c = rng.integers(0, 4, (300, 12)).astype(float), rng.integers(0, 4, (20_000, 12)).astype(float)
    c[:, :6] += rng.integers(0, 3, (20_000, 1))
    nearest = T._Nearest(q, 5)
    for at in (0, 6000):
        nearest.add(c[at : 6000 if at == 0 else None])
    d = (q * q).sum(1)[:, None] - 2 * q @ c.T + (c * c).sum(1)
    assert nearest.places.tolist() == np.argsort(d, axis=1, kind="stable")[:, :5].tolist()
    assert sum(n for _, n in seen) < 0.6 * sum(n for n, _ in seen)


def test_equal_errors_are_told_apart_by_day_order(spark):
    """Errors that are equal but for rounding: sums go by day, as SQL in one thread has them, in whatever order the rows come."""
    from gridloom.functions import metrics as M

    y = {1: 0.0, 8: 21.0, 9: 47.0, 10: 5.0, 11: 2.0, 28: 31.0}
    rows, expected = [(h, y.get(h, 0.0), 7.571428571428571) for h in range(1, 29)], 0.0
    for _, v, c in rows:
        expected += (v - c) * (v - c)
    rng = np.random.default_rng(3)
    for _ in range(4):
        dealt = spark.createDataFrame([rows[i] for i in rng.permutation(28)], "h int, y double, c double").coalesce(1)
        assert dealt.agg(M.mse_in_order("h", F.col("y"), F.col("c")).alias("e")).first()["e"] == expected / 28


def test_pruned_panel_ships_series_and_finds_the_same(spark, monkeypatch):
    """topk_pruned deals series, not windows or a copy of a query for each block; it leaves out pairs where vectors let it, and counts them."""
    monkeypatch.setattr(T, "BLOCK_SIZE", 20)
    rng = np.random.default_rng(11)
    level = np.repeat(10.0 ** rng.integers(0, 4, (30, 10)), 12, axis=1)
    ys = np.concatenate([level + rng.integers(0, 3, level.shape), np.ones((2, 120)), rng.integers(0, 4, (8, 120))]).astype(float)
    ys[39] = ys[38]
    series = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(ys)], "id long, ys array<double>")
    columns = ["qid", "rank", "sid", "t_r", "dist", "c_loc", "c_scale", "cont"]
    get = lambda df: sorted(map(tuple, df.select(columns).collect()))
    queries = W.query_windows(series, 12, 100)
    queries = queries.withColumn("origin", F.when(F.col("qid") % 3 == 0, 60).otherwise(F.col("origin")))
    for scale in ("raw", "znorm"):
        args = (queries, series, 5, 12, 7, 100, 1, scale)
        pruned = T.topk_panel(*args, series_per_block=15, queries_per_block=9, pruned=True)
        assert get(pruned) == get(T.topk_panel(*args))
        computed = {r.qid: r.n for r in pruned.computed.collect()}
        assert set(computed) == set(range(40)) and max(computed.values()) <= 40 * 82
        assert sum(computed.values()) < 0.75 * 40 * 40 * 82 or scale == "znorm"


@pytest.mark.parametrize("spread", [0.05, 9.0])
def test_pruned_nearest_is_exact(monkeypatch, spread):
    monkeypatch.setattr(T, "BLOCK_SIZE", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 5, (9, 10))
    c = (centres[rng.integers(0, 9, 900)] + rng.normal(0, spread, (900, 10))).round(2)
    c[7], c[300] = np.nan, c[20]
    q = np.concatenate([c[20:40], rng.normal(0, 5, (10, 10)), np.zeros((1, 10))])
    legal = rng.random((len(q), len(c))) < 0.7
    plain, pruned = T._Nearest(q, 6), T._Pruned(q, 6)
    for at in range(0, 900, 100):
        part = slice(at, at + 100)
        plain.add(c[part], lambda rows, cols, part=part: legal[:, part][rows, cols])
        pruned.add(c[part], lambda rows, cols, part=part: legal[:, part][rows][:, cols] if isinstance(cols, np.ndarray) else legal[:, part][rows, cols])
    assert (pruned.places == plain.places).all() and (pruned.dist == plain.dist).all()
    assert (pruned.computed.sum() < 0.7 * len(q) * len(c)) == (spread < 1) and pruned.computed.max() <= len(c)
