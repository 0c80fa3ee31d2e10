import random
from itertools import combinations

import pytest

from gridloom.llm import near_dup
from gridloom.llm.common import components
from gridloom.llm.near_dup import keep_one, near_duplicates
from tests.conftest import SF


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    words = lower(text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    """rows: (doc_id, text); doc_ids unique. doc_id -> (size, component)."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    pairs = {p for o in owners.values() for p in combinations(sorted(o), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.representative.doc_id) for r in df.collect())


def edited(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed,rare", [(1, 48), (2, 2), (3, 1)])
def test_groups_against_brute_force(spark, monkeypatch, seed, rare):
    monkeypatch.setattr(near_dup, "RARE", rare)
    rng = random.Random(seed)
    rows = []
    passage = [f"p{k}" for k in range(30)]
    for group in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        if group % 2:
            base = base[:40] + passage
        for copy in range(rng.choice([1, 4, 14])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))))
    rows += [None, "", "  \n\t ", "One", "one", "one two", "ONE two", "x " * 300, "x " * 9]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (2, 70)):
        assert got(near_duplicates(docs, width, percent)) == brute(rows, width, percent)


def test_real_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(near_duplicates(docs, 4, 85)) == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85)


def test_keep_one_and_edges(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(5, text, "a"), (3, text + " more", "b"), (None, text, "c"), (7, "", "d"), (7, "", "e"), (8, None, "f"), (9, "alone here", "g"), (9, "alone here", "h"), (9, "other", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    marks = sorted(r.hash for r in kept.collect())
    assert [m for m in marks if m not in "gh"] == ["b", "d", "e", "f", "i"] and len([m for m in marks if m in "gh"]) == 1
    assert keep_one(spark.createDataFrame([], docs.schema)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(docs, percent=50)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (100, 300), (5, 4)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rare,percent", [(1, 70), (2, 80), (3, 85), (200, 70), (1, 67)])
def test_exact_join_alone_finds_every_link(spark, monkeypatch, rare, percent):
    """Large classes make tokens with many sets and few classes, which come after tokens with fewer sets and more classes;
    sets of few and of many tokens need combinations of different lengths."""
    monkeypatch.setattr(near_dup, "RARE", rare)
    rng = random.Random(rare)
    sets, classes = {}, {}
    for group in range(16):
        base = rng.sample(range(group % 4 * 40, group % 4 * 40 + 60), rng.choice([2, 3, 4, 8, 12, 20, 40]))
        for copy in range(rng.choice([2, 12])):
            sid = len(sets)
            sets[sid] = sorted({rng.randrange(200) if rng.random() < 0.06 else t for t in base})
            classes[sid] = 1000 + group * 3 + rng.choice([0, 0, 0, 0, 1, 2])
    frame = spark.createDataFrame(list(sets.items()), "sid long, tokens array<long>")
    roots = spark.createDataFrame(list(classes.items()), "node long, root long")
    ordered = near_dup.stage(near_dup._ordered(frame, percent), "ordered")
    pairs = near_dup._between(ordered, near_dup._prefixes(ordered), roots, percent)
    found = {(r.a, r.b) for r in near_dup._linked(pairs, frame, percent).collect()}
    near = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})
    expected = {(a, b) for a, b in combinations(sets, 2) if classes[a] != classes[b] and near(a, b)}
    # Equal sets have one id where the join is used.
    different = lambda pairs: {(a, b) for a, b in pairs if sets[a] != sets[b]}
    assert different(expected) and different(found) == different(expected)


def test_frequent_token_before_a_rare_one(spark, monkeypatch):
    """Of ten tokens, sets 1 and 2 share nine; the first of these has three classes, the next is rare."""
    monkeypatch.setattr(near_dup, "RARE", 2)
    sets = {1: [100, *range(1, 10)], 2: [200, *range(1, 10)], 3: [1, 300, 301], 4: [1, 400, 401], 5: [1, 100, 200]}
    frame = spark.createDataFrame(list(sets.items()), "sid long, tokens array<long>")
    ordered = near_dup.stage(near_dup._ordered(frame, 81), "ordered")
    assert (1, 2) in [tuple(r) for r in near_dup._between(ordered, near_dup._prefixes(ordered), None, 81).collect()]


def test_ids_of_text_long_texts_and_extra_columns(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [("b", long, 1), ("a", long + " more", 2), (None, long, 3), ("c", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, block int")
    found = {(r.doc_id, r.n_shingles): r.representative.doc_id for r in near_duplicates(docs, 4, 85).collect()}
    assert found == {("b", 199_997): "a", ("a", 199_998): "a", (None, 199_997): "a", ("c", 0): "c"}
