import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing
from gridloom.llm.mixing import BLOCK, PASSES, apportion, chosen_blocks, mix, passages, targets
from tests.conftest import SF

COLUMNS = "doc_id long, source string, text string, size int, target string"


def shares(sizes, weights):
    """Targets by the definition: share, hold what is above its cap, share the rest again."""
    held, total = set(), sum(sizes.values())
    while True:
        left, free = total - sum(PASSES * sizes[s] for s in held), sum(weights[s] for s in sizes if s not in held)
        found = {s: PASSES * sizes[s] if s in held else left * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in held and found[s] > PASSES * sizes[s]}
        if not over:
            return found
        held |= over


def highest(weights, seats):
    """Sainte-Lague seat by seat."""
    won = Counter()
    for _ in range(seats):
        won[max(weights, key=lambda c: (weights[c] / (2 * won[c] + 1), -c))] += 1
    return won


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, "é": 3, None: 9}, {"a": 0, "b": 0}, {str(k): k * k for k in range(1, 12)}, {"z": 5}])
def test_targets(spark, sizes):
    found = {r.source: r for r in targets(spark.createDataFrame(list(sizes.items()), "source string, words long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    assert [found[s].place for s in order] == list(range(1, len(order) + 1)) and {s: r.weight for s, r in found.items()} == weights
    assert {s: r.target for s, r in found.items()} == pytest.approx(shares(sizes, weights))


@pytest.mark.parametrize("weights,seats", [([5.0, 3.0, 1.0], 9), ([5.0, 5.0, 5.0], 4), ([1.0], 0), ([0.0, 2.0, 0.0], 3), ([1e-9, 1e9, 3.0], 1000), ([float(k * k % 17) for k in range(40)], 11), ([7.3, 2.2] * 30, 999), ([0.0, 0.0], 0)])
def test_seats_go_to_the_highest_quotients(spark, weights, seats):
    cells = spark.createDataFrame([(g, k, w, seats + g) for g in (0, 1) if seats or not g for k, w in enumerate(weights)], "g int, k int, w double, seats int")
    found = {(r.g, r.k): r.quota for r in apportion(cells, ["g"], "k", "w", "seats", "quota").collect()}
    for g in {g for g, _ in found}:
        expected = highest(dict(enumerate(weights)), seats + g)
        assert {k: v for (h, k), v in found.items() if h == g} == {k: expected[k] for k in range(len(weights))}


def test_blocks_of_a_shard():
    assert len(chosen_blocks(0, 5, "x")) == 0
    picked = chosen_blocks(10 * BLOCK + 3, 3, "x")
    assert picked.sum() == 3 and not picked[-1] and len(picked) == 11
    assert (picked == chosen_blocks(10 * BLOCK + 3, 3, "x")).all() and (picked != chosen_blocks(10 * BLOCK + 3, 3, "y")).any()
    assert chosen_blocks(10 * BLOCK + 3, 10, "x").tolist() == [True] * 10 + [False] and chosen_blocks(10 * BLOCK + 3, 12, "x").all()
    assert chosen_blocks(5, 0, "x").tolist() == [False]


def test_real_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= PASSES * r.size and r.taken == r.passes * r.size + sum(s.end - s.start for s in r.spans)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * BLOCK for s in target)
    again = mix(docs.repartition(13)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_small_shards_and_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    monkeypatch.setattr(mixing, "REGION", 4)
    monkeypatch.setattr(mixing, "COPIES", 5)
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", "w " * (k % 50), 1, "t") for k in range(600)] + [(None, "hot", "same words here", 1, "t")] * 37 + [(7, None, "q " * 4000, 1, "t")]
    docs = spark.createDataFrame(rows, COLUMNS)
    whole = mix(docs).collect()
    assert len(whole) == len(rows) and sum(r.doc_id is None for r in whole) == 37
    for few in (0, 100):
        monkeypatch.setattr(mixing, "FEW_SOURCES", few)
        assert sorted(map(str, mix(docs.repartition(5)).collect())) == sorted(map(str, whole))
    taken, target = Counter(), {}
    for r in whole:
        assert 0 <= r.taken <= PASSES * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(r.size for r in whole))
    shards = sum(r.size for r in whole) / 300
    assert all(abs(taken[s] - target[s]) <= BLOCK * (2 + shards / 2) for s in target)


def test_nulls_and_nothing(spark):
    assert mix(spark.createDataFrame([], COLUMNS)).count() == 0
    docs = spark.createDataFrame([(None, None, None, 1, "x"), (1, None, "", 1, "x"), (2, "a", " \t\n", 1, "x")], COLUMNS)
    assert [(r.size, r.target, r.taken, r.source_size) for r in mix(docs).collect()] == [(0, 0.0, 0, 0)] * 3
    # The small source is held at three times its words, and all of it is taken three times.
    docs = spark.createDataFrame([("a", "few", "one two three", 1, "x"), ("b", "many", "w " * 5000, 1, "x")], COLUMNS.replace("doc_id long", "doc_id string"))
    found = {r.doc_id: r for r in mix(docs).collect()}
    assert found["a"].target == 9.0 and found["a"].taken == 9 and found["b"].target == 4994.0


def test_passages(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], " ".join(f"{k}.{j}" for j in range(40 * k)), 1, "x") for k in range(9)], COLUMNS)
    mixed = mix(docs)
    found = Counter()
    for r in passages(docs, mixed).collect():
        words = r.text.split(" ")
        first = int(words[0].split(".")[1])
        assert words == [f"{r.doc_id}.{j}" for j in range(first, first + len(words))]
        found[r.doc_id] += len(words)
    assert found == {r.doc_id: r.taken for r in mixed.collect() if r.taken}


def test_weights_are_a_parameter(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], "w " * 64, 1, "x") for k in range(40)], COLUMNS)
    found = {r.source: r.target for r in mix(docs, weight=F.when(F.col("source") == "a", 3.0).otherwise(1.0)).collect()}
    assert found == {"a": 1920.0, "b": 640.0}
