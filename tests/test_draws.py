"""Draws, resamples and the isotonic crossing against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.draws import permuted, poisson_counts, uniforms
from gridloom.operators import diagnostics as D
from gridloom.operators import retrieval as T
from gridloom.operators import splits
from gridloom.sources import tables


def hash60(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def plain_permuted(place, n, *key):
    side = 2 ** (((max(n - 1, 1)).bit_length() + 1) // 2)
    while True:
        left, right = divmod(place, side)
        for k in range(4):
            left, right = right, (left + hash60(*key, k, right) % side) % side
        place = left * side + right
        if place < n:
            return place


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 100])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), 5, F.lit("x")).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.p == plain_permuted(r.id, n, 5, "x") for r in rows)


def test_poisson_counts():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(7)
    for mean in (1, 3, 400):
        drawn = poisson_counts(keys, np.full(len(keys), mean), 3, 1)
        assert np.abs(drawn.mean(0) - mean).max() < 0.05 * math.sqrt(mean) and np.abs(drawn.var(0) / mean - 1).max() < 0.06
    assert not poisson_counts(keys[:5], np.zeros(5, int), 4, 1).any()
    u = uniforms(keys, 2, 0)
    assert 0 <= u.min() and u.max() < 1 and abs(np.corrcoef(u.T)[0, 1]) < 0.03 and (uniforms(keys[5:6], 2, 0) == u[5:6]).all()


def test_resamples_don_t_follow_the_partitions(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in rng.random((500, 2)).round(2)], "a double, b double")
    one, two = (D.bootstrap_mean_difference(rows.repartition(p), "a", "b", 500).first() for p in (1, 9))
    assert (one.low, one.high) == pytest.approx((two.low, two.high), abs=1e-12) and one.low < one.mean < one.high
    assert D.bootstrap_mean_difference(rows, "a", "b", 500, seed=1).first().low != one.low


def pool_adjacent(y, w):
    blocks = []
    for value, weight in zip(y, w):
        blocks.append([float(value), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def plain_crossing(x, wins, n):
    kept = n > 0
    x, y, w = x[kept], wins[kept] / n[kept], n[kept]
    fit = pool_adjacent(y, w)
    below = int((fit < 0.5 - 1e-12).sum())
    if below in (0, len(fit)):
        return None
    return float(np.interp(0.5, fit[below - 1 : below + 1], x[below - 1 : below + 1]))


@pytest.mark.parametrize("seed,distinct,size", [(0, 30, 8), (1, 400, 64), (2, 3, 2), (3, 700, 2048)])
def test_crossing_and_its_resamples(spark, monkeypatch, seed, distinct, size):
    monkeypatch.setattr(D, "RANGE_SIZE", size)
    monkeypatch.setattr(D, "CHUNK", 16)
    rng = np.random.default_rng(seed)
    x = rng.integers(0, distinct, 900) / distinct
    u = np.where(rng.random(900) < 0.15 + 0.7 * x, 1.0, -1.0)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, u)], "x double, utility double")
    values = np.unique(x)
    wins, n = np.array([(u[x == v] > 0).sum() for v in values]), np.array([(x == v).sum() for v in values])
    keys = D.scrambled(values.view(np.uint64))
    won, lost = poisson_counts(keys, wins, 60, 5), poisson_counts(~keys, n - wins, 60, 5)
    plain = [c for k in range(60) if (c := plain_crossing(values, won[:, k], won[:, k] + lost[:, k])) is not None]
    found = D.isotonic_crossing(rows, 60, 5)
    point = plain_crossing(values, wins, n)
    assert found["crossing"] == (None if point is None else pytest.approx(point, abs=1e-9))
    if len(plain) >= 20:
        assert (found["low"], found["high"]) == pytest.approx(tuple(np.quantile(plain, [0.025, 0.975])), abs=1e-9)
    split = np.median(x) if point is None else point
    assert found["n_below"] == (x < split).sum() and found["win_rate_above"] == pytest.approx((u[x >= split] > 0).mean())


def test_crossing_of_50000_values(spark):
    rng = np.random.default_rng(9)
    x = np.sort(rng.random(50_000))
    u = np.where(rng.random(50_000) < x**2, 1.0, -1.0)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, u)], "x double, utility double")
    found = D.isotonic_crossing(rows, 40)
    assert found["crossing"] == pytest.approx(plain_crossing(x, (u > 0) * 1.0, np.ones(len(x))), abs=1e-9)
    assert math.sqrt(0.5) - 0.05 < found["low"] <= found["high"] < math.sqrt(0.5) + 0.05


def test_no_crossing(spark):
    rows = lambda u: spark.createDataFrame([(float(k), u(k)) for k in range(50)] + [(None, 1.0), (float("nan"), 1.0)], "x double, utility double")
    assert D.isotonic_crossing(rows(lambda k: 1.0), 10)["crossing"] is None and D.isotonic_crossing(rows(lambda k: -1.0), 10)["crossing"] is None
    found = D.isotonic_crossing(rows(lambda k: 1.0 if k < 20 else -1.0), 10)
    # The fit is constant; wins and losses are told for both sides of the median.
    assert found["n"] == 50 and found["crossing"] is None and (found["win_rate_below"], found["win_rate_above"]) == (0.8, 0.0)
    inside = D.band(rows(lambda k: 1.0 if 10 <= k < 40 else -1.0), 30)
    # From the last loss to the block of 30 wins and 10 losses after it, of height 3 / 4.
    assert inside["low"] == pytest.approx(9 + 2 / 3) and inside["high"] == pytest.approx(40 - 2 / 3) and inside["win_rate_inside"] == 1.0 and inside["n_outside"] == 20


def test_subset_of_exactly_n(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id % 300 AS id", "id AS v").unionAll(spark.createDataFrame([(None, 1)], "id long, v long"))
    for bits in (0, 2, 16):
        monkeypatch.setattr(tables, "DRAW_BITS", bits)
        for n in (0, 1, 37, 300, 999):
            got = {r.id for r in tables.select_subset(rows.repartition(5), n, 3).collect()}
            assert got == set(sorted(range(300), key=lambda k: (hash60(3, k), k))[:n])


def test_numbers_and_permutation_sample(spark, monkeypatch):
    monkeypatch.setattr(tables, "SAMPLE", 64)
    monkeypatch.setattr(tables, "RANGES", 9)
    rng = np.random.default_rng(2)
    rows = [(int(a), None if b == 3 else f"k{b}") for a, b in rng.integers(0, 30, (500, 2))]
    df = spark.createDataFrame(rows, "a int, b string").repartition(6)
    got = sorted(tables.numbered(df, ["a", "b"]).collect(), key=lambda r: r.number)
    assert [r.number for r in got] == list(range(500)) and [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    keys = sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    chosen = {k for i, k in enumerate(keys) if plain_permuted(i, len(keys), 8) < 25}
    assert {(r.a, r.b) for r in tables.permutation_sample(df, 25, 8, ["a", "b"]).collect()} == chosen and len(chosen) == 25


def test_random_windows(spark, monkeypatch):
    monkeypatch.setattr(T, "SERIES_A_PART", 4)
    sizes = [40, 12, 9, 10, 33, 40, 40, 25, 11, 40, 40]
    series = spark.createDataFrame([(k, [0.0] * n, k % 2) for k, n in enumerate(sizes)], "id long, ys array<double>, store int")
    asked = [(100 + k, [35, 20, 36, 5][k % 4], [0, 1, None][k % 3]) for k in range(60)]
    queries = spark.createDataFrame(asked, "qid long, origin int, store int")
    legal = lambda store, origin: {(s, t) for s, n in enumerate(sizes) if s % 2 == store for t in range(6, min(38, n) - 4 + 1, 3) if t + 4 < origin}
    for k in (3, 1000):
        found = {}
        for r in T.random_choice(queries, series, k, 6, 4, 38, 3, 1, ["store"]).collect():
            found.setdefault(r.qid, []).append((r["rank"], r.sid, r.t_r))
        for qid, origin, store in asked:
            pool = legal(store, origin)
            got = [x[1:] for x in sorted(found.get(qid, []))]
            assert got == sorted(set(got)) and set(got) <= pool and len(got) == min(k, len(pool))
    many = spark.range(3000).selectExpr("id AS qid", "35 AS origin", "0 AS store")
    counts = {}
    for r in T.random_choice(many, series, 2, 6, 4, 38, 3, 1, ["store"]).collect():
        counts[r.sid, r.t_r] = counts.get((r.sid, r.t_r), 0) + 1
    pool = legal(0, 35)
    expected = 6000 / len(pool)
    assert set(counts) == pool and sum((c - expected) ** 2 / expected for c in counts.values()) < len(pool) + 5 * math.sqrt(2 * len(pool))


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_pruned_search(spark, blocks):
    rng = np.random.default_rng(blocks)
    centres = rng.normal(0, 5, (12, 10))
    c = np.concatenate([centres[rng.integers(0, 12, 700)] + rng.normal(0, 0.3, (700, 10)), np.zeros((90, 10))]).round(2)
    q = np.concatenate([c[:30] + 0.1, rng.normal(0, 9, (10, 10)), np.zeros((2, 10))])
    days = rng.integers(0, 50, len(c))
    candidates = spark.createDataFrame([(i % 100, int(d), [float(v) for v in x]) for i, (x, d) in enumerate(zip(c, days))] + [(1, 3, None), (2, 3, [float("nan")] * 10)], "id long, t_r int, cvec array<double>")
    queries = spark.createDataFrame([(i, int(o), [float(v) for v in x]) for i, (x, o) in enumerate(zip(q, np.where(np.arange(len(q)) % 5, 60, 20)))] + [(77, 60, None)], "qid long, origin int, vec array<double>")
    index = T.PrunedSearch(candidates, 4, blocks)
    found = index.search(queries, 6, candidates_per_group=100, queries_per_group=9)
    got = sorted((r.qid, r["rank"], r.sid, r.t_r, r.dist) for r in found.collect())
    expected = []
    for i, (x, o) in enumerate(zip(q, np.where(np.arange(len(q)) % 5, 60, 20))):
        near = sorted((round(float(((y - x) ** 2).sum()), 9), k % 100, int(d)) for k, (y, d) in enumerate(zip(c, days)) if d + 4 < o)[:6]
        expected += [(i, n + 1, s, t, dist) for n, (dist, s, t) in enumerate(near)]
    assert [g[:4] for g in got] == [e[:4] for e in expected] and [g[4] for g in got] == pytest.approx([e[4] for e in expected], abs=2e-9)
    computed = {r.qid: r.n for r in index.computed.collect()}
    assert set(computed) == set(range(len(q))) and max(computed.values()) <= len(c)
    if blocks == 60:
        assert sum(computed.values()) < 0.4 * len(q) * len(c)


def test_pruned_search_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, t_r int, cvec array<double>")
    one = spark.createDataFrame([(1, 5, [1.0])], "qid long, origin int, vec array<double>")
    assert T.PrunedSearch(empty, 1).search(one, 3).count() == 0
    assert T.PrunedSearch(spark.createDataFrame([(1, 9, [1.0])], "id long, t_r int, cvec array<double>"), 1).search(one, 3).count() == 0


def test_overlaps(spark):
    rng = np.random.default_rng(1)
    spans = lambda n: [(int(k), int(a), int(a + b)) for k, a, b in zip(rng.integers(0, 3, n), rng.integers(-50, 400, n), rng.integers(-3, 150, n))]
    train, evaluated = spans(80), spans(40)
    found = splits.overlapping_windows(spark.createDataFrame(train, "id int, ts int, te int"), spark.createDataFrame(evaluated, "id int, es int, ee int"), ["id"], width=30)
    expected = sorted((i, a, b, c, d) for i, a, b in train for j, c, d in evaluated if i == j and a <= b and c <= d and a <= d and c <= b)
    assert sorted((r.id, r.ts, r.te, r.es, r.ee) for r in found.collect()) == expected and expected
    apart = spark.createDataFrame([(500, 510)], "es int, ee int")
    splits.require_no_overlap(spark.createDataFrame([(1, 499)], "ts int, te int"), apart)
    with pytest.raises(splits.LeakageError):
        splits.require_no_overlap(spark.createDataFrame([(1, 500)], "ts int, te int"), apart)
    whole = splits.rolling_splits(spark, 100, 10)
    assert splits.check_splits(whole, last_labelled=100).count() == 4
    with pytest.raises(splits.LeakageError):
        splits.check_splits(whole, last_labelled=99)


def test_command_line(tmp_path, capsys):
    from gridloom.__main__ import main

    assert main(["version"]) == 0 and main(["env", "--json"]) == 0
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"windows": {"train": [[1, 5]], "eval": [[6, 9]]}}')
    bad.write_text('{"windows": {"train": [[1, 6]], "eval": [[6, 9]]}}')
    assert main(["audit", str(good)]) == 0 and main(["audit", str(bad)]) == 2
    assert "FAIL windows" in capsys.readouterr().out
    assert tables.set_seed(3).random() == np.random.default_rng(3).random()
