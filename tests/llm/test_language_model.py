import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm.language_model import DEPTH, codes_of, lgamma, score_texts
from gridloom.llm.queries import op5_context_tree_scores
from pyspark.sql import functions as F
from tests.conftest import SF


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 8, 33.5, 1e6 + 0.5])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_codes():
    top = 8 * DEPTH
    assert codes_of([b"ab", b""]).tolist() == [97, (97 << top) + 98, (98 << top) + (97 << top - 8), 0]


class Tree:
    """A context tree as the textbook has it: counts and weighted probabilities by recursion."""

    def __init__(self, texts):
        self.counts = Counter()
        self.below = {}
        for t in texts:
            for context, decision, bit in self.decisions(t):
                for d in range(DEPTH + 1):
                    self.counts[context[:d], decision, bit] += 1
                    if d:
                        self.below.setdefault((context[: d - 1], decision), set()).add(context[:d])

    @staticmethod
    def decisions(text):
        stream = bytes(DEPTH) + text + b"\0"
        for k in range(DEPTH, len(stream)):
            context = bytes(stream[k - d] for d in range(1, DEPTH + 1))
            decision = 1
            for i in range(7, -1, -1):
                bit = stream[k] >> i & 1
                yield context, decision, bit
                decision = decision << 1 | bit

    def pe(self, c, v):
        a, b = self.counts[c, v, 0], self.counts[c, v, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def pw(self, c, v):
        if len(c) == DEPTH:
            return self.pe(c, v)
        return np.logaddexp(self.pe(c, v), sum(self.pw(x, v) for x in self.below.get((c, v), ()))) - math.log(2)

    def p(self, c, v, bit, d=0):
        a, b = self.counts[c[:d], v, 0], self.counts[c[:d], v, 1]
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == DEPTH:
            return kt
        w = math.exp(self.pe(c[:d], v) - math.log(2) - self.pw(c[:d], v))
        return w * kt + (1 - w) * self.p(c, v, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.p(*x)) for x in self.decisions(text))


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def check(rows, found, learned):
    train = Counter(w for (i, t), y in zip(rows, learned) if y for w in words(t))
    n, v = sum(train.values()), len(train)
    tree = Tree([(t or "").encode() for (_, t), y in zip(rows, learned) if y])
    expected = []
    for (i, t), y in zip(rows, learned):
        w = words(t)
        expected.append((i, y, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), tree.score((t or "").encode())))
    key = lambda r: (str(r[0]), r[2], round(r[6], 3))
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], rel=1e-5, abs=1e-5)


def test_against_the_textbook(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abc de\né") for _ in range(rng.randrange(40)))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "A a"), (42, "A a"), (None, "xyz"), (43, "Unseen #\0 bytes ☃")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = [i is not None and i % 4 != 1 for i, _ in rows]
    check(rows, score_texts(docs, F.col("doc_id") % 4 != 1).collect(), learned)
    none = score_texts(docs, F.lit(False)).collect()
    assert all(r.score == pytest.approx(-8 * math.log10(2) * (len((t or "").encode()) + 1), rel=1e-6) for r, t in ((r, dict(rows)[r.doc_id]) for r in none))
    assert score_texts(spark.createDataFrame([], docs.schema), F.lit(True)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_context_tree_scores(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > -2.5 * math.log10(2) * sum(len(docs[r.doc_id].encode()) + 1 for r in held)
