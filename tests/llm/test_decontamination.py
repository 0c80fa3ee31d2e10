import random
import re

import numpy as np
import pytest

from gridloom.llm import decontamination
from gridloom.llm.decontamination import FMIndex, contamination, decontaminate, digest, sha256_of, suffix_order
from tests.conftest import SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, width=10):
    windows = {}
    for item, text in bench:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), sha256_of(list(items)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(8))
def test_index_finds_what_a_scan_finds(seed):
    rng = np.random.default_rng(seed)
    text = np.where(rng.random(400) < 0.1, 0, rng.integers(1, 4, 400))
    text[-1] = 0
    order = suffix_order(text)
    assert sorted(order) == list(range(400))
    index = FMIndex(text, 3)
    for n in (1, 2, 5):
        patterns = rng.integers(1, 4, (30, n))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            places = [k for k in range(400 - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == places


def test_small_vocabulary_against_brute_force(spark):
    rng = random.Random(5)
    bench = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([1, 4, 11, 14])))) for i in range(12)] + [(77, ""), (78, None), (79, "a!B-c")]
    docs = [(i, " ".join(rng.choice("abcd.") for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, ""), (3, "A b, C")]
    got = digest(contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, bench)


@pytest.mark.parametrize("size", [decontamination.PART_BYTES, 40, 3000])
def test_real_tables_against_brute_force(spark, monkeypatch, size):
    """A part of the benchmark may have one item or some."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    if size == 40:
        docs, bench = docs.where("doc_id < 40"), bench.limit(4)
        size = bench.selectExpr("sum(octet_length(text))").first()[0] // 3
    monkeypatch.setattr(decontamination, "PART_BYTES", size)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted((tuple(r) for r in digest(contamination(docs, bench)).collect()), key=str) == expected
    assert any(r[-1] for r in expected) or docs.count() == 40
    cleaned = decontaminate(docs, bench)
    assert cleaned.schema == docs.schema
    assert not contamination(cleaned, bench).where("n_hit > 0").count()
    untouched = {r[0] for r in expected if not r[-1]}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, cleaned))
    assert before.keys() == after.keys() and all(before[k] == after[k] for k in untouched)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert {tuple(r) for r in digest(contamination(some, bench)).collect()} == {
        (1, 2, 0, 0, sha256_of([]), False),
        (None, 0, 0, 0, sha256_of([]), False),
    }


def test_ids_of_text_and_a_long_text(spark):
    item = " ".join(f"b{k}" for k in range(15))
    docs = [("x", ("fill " * 9 + item + ". ") * 20_000), (None, item.upper())]
    got = digest(contamination(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("i", item)], "item_id string, text string")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("x", 480_000, 300_000, 1, sha256_of(["i"]), True), (None, 15, 15, 1, sha256_of(["i"]), True)]
