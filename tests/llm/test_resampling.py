import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from gridloom.llm import resampling
from gridloom.llm.resampling import CRC, bucket_counts, continued, draw, features, resample
from tests.conftest import SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score string, n_words int"


def buckets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    rows = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in buckets(x)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (whole_s + 10_000)) / ((s[b] + 1) * (whole_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:]))
    drawn = order[: 5 * len(order) // 100]
    left = Counter(out) - Counter(drawn)
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in left.elements()], key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_real_tables(spark):
    docs, target = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert found(resample(docs, target)) == expected and sum(r[-1] is not None for r in expected) > 5
    assert found(resample(docs.repartition(11), target)) == expected


def test_odd_rows(spark):
    rng = random.Random(0)
    words = ["a", "É", "Zoë", "b-c", "x" * 70, "1.5", "日本", "\x00", "\n\n", "y" * 48, "z" * 49]
    rows = [(rng.choice([None, 1, *range(300)]), " ".join(rng.choices(words, k=rng.randint(0, 60))), "s", 1) for _ in range(900)]
    rows += [(None, "the same words over and over " * 5, "s", 1)] * 200 + [(5, None, None, None), (6, "", "", 0), (9, "long text " * 60_000, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = ["the same words", None, "", "日本 É a"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    expected = plain([(r[0], r[1]) for r in rows], target)
    assert found(resample(docs, frame)) == expected
    for size in (1, 64, 1000):
        texts = [(t or "").encode() for _, t, *_ in rows[:60]] + [b"long text " * 300]
        counts, total = np.zeros(len(texts), int), Counter()
        for numbers, n, (place, bucket) in pieces_of(texts, size):
            counts[numbers] += n
            total.update(zip(numbers[place].tolist(), bucket.tolist()))
        assert counts.tolist() == [buckets(t.decode())[0] for t in texts]
        assert total == Counter((k, b) for k, t in enumerate(texts) for b in buckets(t.decode())[1])


def pieces_of(texts, size):
    before, resampling.PIECE = resampling.PIECE, size
    try:
        return list(features(texts))
    finally:
        resampling.PIECE = before


def test_crc_goes_on():
    data = b"abc" + b"de" * 100 + b"f"
    buffer = np.frombuffer(data, np.uint8)
    spans = [(0, 3), (3, 3), (3, 203), (203, 204), (0, 48), (0, 49)]
    before = np.array([0, 7, 12345, 2**32 - 1, 99, 100], np.uint32)
    got = continued(buffer, *(np.array(x) for x in zip(*spans)), before)
    assert got.tolist() == [zlib.crc32(data[a:b], int(c)) for (a, b), c in zip(spans, before)]
    assert len(CRC) == 256


def test_draw_within_ties_and_bins(spark, monkeypatch):
    rng = random.Random(2)
    for bins in (1, 2, 7, 10_000):
        monkeypatch.setattr(resampling, "BINS", bins)
        rows = [(rng.choice([None, *range(400)]), rng.choice([-5, 0, 0, 0, 3, rng.randint(-9999, 9999)])) for _ in range(1000)]
        scored = spark.createDataFrame(rows, "doc_id long, score long")
        out = draw(scored, scored["score"] != 3, 30)
        order = sorted((r for r in rows if r[1] != 3), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        drawn = order[: 30 * len(order) // 100]
        left = Counter(rows) - Counter(drawn)
        assert found(out) == sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in left.elements()], key=repr)


def test_nothing(spark):
    empty, item = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert resample(empty, item).count() == 0 and not bucket_counts(empty).any()
    docs = spark.createDataFrame([("x", "one " * 30), (None, None)], "doc_id string, text string")
    assert found(resample(docs, item)) == [r for r in plain([("x", "one " * 30), (None, None)], [])]
    assert found(resample(docs, docs))
