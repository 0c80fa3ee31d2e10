import hashlib
import re
from collections import Counter

import xxhash

from gridloom.llm import imatch
from gridloom.llm.imatch import fingerprints, lexicon_of
from tests.conftest import SF


RATES = (3, 6, 12, 24, 48, 96, 192, 384, 768)


def own_terms(text):
    return set(re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()))


def own_signature(text, lexicon):
    """The hash of all terms, and of those of each of 63 subsets, seven a rate."""
    found = sorted(own_terms(text) & lexicon)
    out = [(xxhash.xxh32(b" ".join(found), 1) if found else xxhash.xxh32(text.encode(), 2)).intdigest() or 1]
    for k in range(7 * len(RATES)):
        some = [t for t in found if xxhash.xxh64(t, k + 1).intdigest() % RATES[k // 7] == 0]
        out.append((xxhash.xxh32(b" ".join(some), 3).intdigest() or 1) if some else 0)
    return out


def own_likeness(a, b):
    return sum(x == y and x > 0 for x, y in zip(a, b)) / sum(x > 0 or y > 0 for x, y in zip(a, b))


def brute(rows):
    """rows: (doc_id, text, spark's hash)."""
    n = len(rows)
    df = Counter(x for _, t, _ in rows for x in own_terms(t or ""))
    lexicon = {t for t, c in df.items() if max(2, 0.001 * n) <= c <= 0.2 * n}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    out = []
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % n][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (own_signature(x, lexicon) for x in (t, edited, nxt))
        hexed = ["".join(f"{x:08x}" for x in s) for s in (a, b)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexed, own_likeness(a, b), own_likeness(a, c)))
    return lexicon, sorted(out, key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()]


def test_real_table_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon, expected = brute(rows_of(docs))
    assert lexicon_of(docs).keys() == lexicon and len(lexicon) > 100
    for size, fine in ((imatch.RANGE_BYTES, 1024), (20_000, 1024), (10_000, 4)):
        monkeypatch.setattr(imatch, "RANGE_BYTES", size)
        monkeypatch.setattr(imatch, "FINE", fine)
        assert sorted((tuple(r) for r in fingerprints(docs).collect()), key=str) == expected
    near = [(r[5], r[6]) for r in expected]
    assert sum(a for a, _ in near) > 2 * sum(b for _, b in near)


def test_edges(spark):
    rows = [(1, "a b c"), (2, "a b c"), (None, "b c d ä"), (3, None), (4, ""), (4, "b"), (4, "b"), (9, "x " * 3000), (11, "a ä " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in fingerprints(docs).collect()), key=str)
    assert found == brute(rows_of(docs))[1]
    by = {(r[0], r[1]): r for r in found}
    assert by[1, 5][3] == by[2, 5][3] and by[3, 0][3] == by[4, 0][3] != by[9, 6000][3]
    one = fingerprints(spark.createDataFrame([(1, "abc d")], docs.schema)).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcab").hexdigest()
    assert fingerprints(spark.createDataFrame([], docs.schema)).count() == 0
