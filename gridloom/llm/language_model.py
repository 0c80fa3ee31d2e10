"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision (a prefix of the byte's bits) has a context tree over the bytes before,
up to DEPTH of them. At every node a Krichevsky-Trofimov estimate of the decision is mixed, with the weight that training
gives it, with what the deeper contexts say. After training the tree is fixed.

The corpus is scanned once into blocks. A block sends its distinct words and byte contexts, with training counts, to
buckets where those of all blocks meet; a bucket answers each block with global word counts and with the log probability of
each byte in each of the block's contexts. Neither vocabulary nor tree is ever gathered in one place or broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, any_type, pack_texts, release, stage, unpack_texts

DEPTH = 6
BLOCK_BYTES = 16 << 20
#: A bucket has the distinct words or contexts of so many bytes of text.
BUCKET_BYTES = 12 << 20
SLICE = 2 << 20
LN2 = float(np.log(2.0))


def pack_words(words: list[bytes], counts: list[int]) -> bytes:
    head = np.array([len(words), *counts], np.int64).tobytes()
    return zstandard.compress(head + b"\n".join(words), 3)


def unpack_words(packed: bytes) -> tuple[list[bytes], np.ndarray]:
    data = zstandard.decompress(packed)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return data[8 * (n + 1) :].split(b"\n") if n else [], np.frombuffer(data, np.int64, n, 8)


def pack_codes(codes: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(codes.astype(np.int64), prepend=0)
    return zstandard.compress(np.int64(len(codes)).tobytes() + steps.tobytes() + counts.astype(np.int64).tobytes(), 3)


def unpack_codes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(packed)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.cumsum(np.frombuffer(data, np.int64, n, 8)), np.frombuffer(data, np.int64, n, 8 * (n + 1))


def codes_of(texts: list[bytes]) -> np.ndarray:
    """For each byte of each text and its end: the bytes before it, latest first, then the byte, as one number.

    Before a text stand zeros; its end is a zero."""
    gap = bytes(DEPTH)
    stream = np.frombuffer(gap + b"".join(t + b"\0" + gap for t in texts), np.uint8).astype(np.int64)
    n = len(stream) - DEPTH
    code = np.zeros(n, np.int64)
    for back in range(1, DEPTH + 1):
        code = code << 8 | stream[DEPTH - back : DEPTH - back + n]
    code = code << 8 | stream[DEPTH:]
    ends = np.cumsum([len(t) + 1 + DEPTH for t in texts])
    inside = np.ones(n, bool)
    for back in range(1, DEPTH + 1):
        inside[ends - back] = False
    return code[inside]


#: All contexts below so many latest bytes meet in one bucket; nodes nearer the root are summed over buckets.
MET = 3


def _bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By the MET latest bytes, so that all deeper contexts of these meet."""
    return (((codes >> 8 * (DEPTH + 1 - MET)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _dealt_codes(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts codes of one bucket together (sorted codes stay sorted), and each present bucket with its range."""
    bucket = _bucket_of(codes, buckets)
    order = np.argsort(bucket, kind="stable")
    present, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(codes))
    return order, list(zip(present.tolist(), starts.tolist(), ends.tolist(), strict=True))


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def block_codes(texts: list[bytes], learn: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a block, sorted, with their counts in the texts to learn from (0 if only in others)."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for which in (True, False):
        for some in _slices([t for t, y in zip(texts, learn, strict=True) if y == which]):
            u, c = np.unique(codes_of(some), return_counts=True)
            codes, counts = add_up([codes, u], [counts, c if which else np.zeros(len(u), np.int64)])
    return codes, counts


def add_up(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, counted = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(codes, kind="stable")
    codes, counted = codes[order], counted[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counted, first) if len(first) else counted


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5, by Stirling's series after shifting small arguments up by eight."""
    shift = np.zeros_like(x)
    small = x < 8
    product = np.ones(int(small.sum()))
    for k in range(8):
        product *= x[small] + k
    shift[small] = np.log(product)
    y = np.where(small, x + 8, x)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


HALF = 0.5723649429247001  # ln gamma(1/2)


def block_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any one sequence of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * HALF - lgamma(a + b + 1.0)


def weighted(own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, deeper) - LN2


class Subtrees:
    """The contexts of MET bytes and more below a bucket's latest bytes, from codes and training counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.keys: dict[int, np.ndarray] = {DEPTH: codes}
        self.up: dict[int, np.ndarray] = {}
        own = {DEPTH: counts.astype(float)}
        for d in range(DEPTH - 1, MET - 1, -1):
            deeper = self.keys[d + 1]
            self.keys[d], self.up[d + 1] = np.unique(deeper >> 16 << 8 | deeper & 255, return_inverse=True)
            own[d] = np.bincount(self.up[d + 1], weights=own[d + 1], minlength=len(self.keys[d]))
        #: By depth and bit: of each key the node, and of each node zeros, ones, ln P_e and ln P_w.
        self.node: dict[tuple[int, int], np.ndarray] = {}
        self.stats: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for bit in range(8):
            below = None
            for d in range(DEPTH, MET - 1, -1):
                prefix = self.keys[d] >> (8 - bit)
                node = np.concatenate([[0], np.cumsum(prefix[1:] != prefix[:-1])]) if len(prefix) else np.zeros(0, np.int64)
                n = int(node[-1]) + 1 if len(node) else 0
                one = (self.keys[d] >> (7 - bit)) & 1
                b = np.bincount(node, weights=own[d] * one, minlength=n)
                a = np.bincount(node, weights=own[d] * (1 - one), minlength=n)
                pe = pw = block_probability(a, b)
                if below is not None:
                    above = np.zeros(len(below), np.int64)
                    above[self.node[d + 1, bit]] = node[self.up[d + 1]]
                    pw = weighted(pe, np.bincount(above, weights=below, minlength=n))
                below = pw
                self.node[d, bit], self.stats[d, bit] = node, (a, b, pe, pw)

    def _above(self, bit: int) -> np.ndarray:
        """Of each node of MET bytes the one above it, as two bytes and a decision (1 to 255)."""
        node = self.node[MET, bit]
        first = self.keys[MET][np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))] if len(node) else node
        return (first >> 16) << 8 | 1 << bit | (first & 255) >> (8 - bit)

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of two bytes: keys, and zeros, ones and ln P_w summed over the byte before them."""
        keys = np.concatenate([self._above(bit) for bit in range(8)])
        values = np.concatenate([np.stack([self.stats[MET, bit][k] for k in (0, 1, 3)]) for bit in range(8)], 1)
        found, place = np.unique(keys, return_inverse=True)
        return found, np.stack([np.bincount(place, weights=v, minlength=len(found)) for v in values])

    def log_probabilities(self, top: Top) -> np.ndarray:
        """ln probability of each code's byte in its context."""
        total = np.zeros(len(self.keys[DEPTH]))
        next_byte = self.keys[DEPTH] & 255
        latest = self.keys[DEPTH] >> (8 * DEPTH)
        for bit in range(8):
            one = (next_byte >> (7 - bit)) & 1
            row = np.arange(len(self.keys[DEPTH]))
            layers = []
            for d in range(DEPTH, MET - 1, -1):
                a, b, pe, pw = self.stats[d, bit]
                node = self.node[d, bit][row]
                layers.append(((b[node] + 0.5) / (a[node] + b[node] + 1), np.exp(pe[node] - LN2 - pw[node])))
                if d > MET:
                    row = self.up[d][row]
            above = np.searchsorted(top.keys2, self._above(bit))
            layers.append((top.kt2[above][node], top.weight2[above][node]))
            decision = 1 << bit | next_byte >> (8 - bit)
            layers.append((top.kt1[latest, decision], top.weight1[latest, decision]))
            layers.append((top.kt0[decision], top.weight0[decision]))
            p = layers[0][0]
            for kt, w in layers[1:]:
                p = w * kt + (1 - w) * p
            total += np.log(np.where(one == 1, p, 1 - p))
        return total


class Top:
    """Contexts of up to two bytes: at most 65,793 * 255 nodes whatever the corpus, of which texts have some hundred thousand."""

    def __init__(self, keys: np.ndarray, sums: np.ndarray):
        """keys: two bytes (latest first) and a decision, sorted; sums: zeros, ones and ln P_w below."""
        self.keys2 = keys
        a, b, deeper = sums
        pe = block_probability(a, b)
        pw = weighted(pe, deeper)
        self.kt2, self.weight2 = (b + 0.5) / (a + b + 1), np.exp(pe - LN2 - pw)
        place = (keys >> 16) << 8 | keys & 255
        a, b, deeper = (np.bincount(place, weights=v, minlength=1 << 16).reshape(256, 256) for v in (a, b, pw))
        pe = block_probability(a, b)
        pw = weighted(pe, deeper)
        self.kt1, self.weight1 = (b + 0.5) / (a + b + 1), np.exp(pe - LN2 - pw)
        a, b = a.sum(0), b.sum(0)
        pe = block_probability(a, b)
        self.kt0, self.weight0 = (b + 0.5) / (a + b + 1), np.exp(pe - LN2 - weighted(pe, pw.sum(0)))


def _scan(docs: DataFrame, buckets: int) -> DataFrame:
    def emit(block: int, texts: list[bytes], ids: list, learn: list[bool], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = [("text", 0, block, pack_texts(texts), ids, learn)]
        counts: Counter[bytes] = Counter()
        for text, y in zip(texts, learn, strict=True):
            if y:
                counts.update(text.translate(LOWER).split())
        for text, y in zip(texts, learn, strict=True):
            if not y:
                for w in text.translate(LOWER).split():
                    if w not in counts:
                        counts[w] = 0
        for b, words in dealt(counts, buckets).items():
            rows.append(("word", b, block, pack_words(words, [counts[w] for w in words]), None, None))
        yield _batch(rows, id_type)
        del counts
        codes, counted = block_codes(texts, learn)
        order, ranges = _dealt_codes(codes, buckets)
        rows = [("code", b, block, pack_codes(codes[order[at:end]], counted[order[at:end]]), None, None) for b, at, end in ranges]
        if rows:
            yield _batch(rows, id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        texts: list[bytes] = []
        ids: list = []
        learn: list[bool] = []
        size = 0
        id_type = pa.int64()
        for batch in batches:
            raw, id_type = batch.column("text").cast(pa.binary()), batch.schema.field("doc_id").type
            for k, (doc_id, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist(), strict=True)):
                text = raw[k].as_py() or b""
                if texts and size + len(text) > BLOCK_BYTES:
                    yield from emit(block, texts, ids, learn, id_type)
                    release()
                    block, size, texts, ids, learn = block + 1, 0, [], [], []
                texts.append(text)
                ids.append(doc_id)
                learn.append(bool(y))
                size += len(text)
        if texts:
            yield from emit(block, texts, ids, learn, id_type)

    return docs.mapInArrow(run, f"kind string, bucket int, block long, payload binary, doc_ids array<{any_type(docs)}>, learn array<boolean>")


def dealt(words, buckets: int) -> dict[int, list[bytes]]:
    """Distinct words, sorted, by bucket."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(id_type), pa.list_(pa.bool_())]
    names = ["kind", "bucket", "block", "payload", "doc_ids", "learn"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


ANSWER = "kind string, bucket int, block long, payload binary"


def _answers(kind: str, table: pa.Table, payloads: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "kind": pa.array([kind] * table.num_rows),
            "bucket": table.column("bucket"),
            "block": table.column("block"),
            "payload": pa.array(payloads, pa.binary()),
        }
    )


def _count_words(table: pa.Table) -> pa.Table:
    """A bucket's words: each block gets the training counts of its words; block -1 the sums of counts and of words."""
    total: dict[bytes, int] = {}
    lists = []
    for packed in table.column("payload"):
        words, counts = unpack_words(packed.as_py())
        lists.append(words)
        for w, c in zip(words, counts.tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    answers = _answers("word", table, [zstandard.compress(np.array([total[w] for w in words], np.int64).tobytes()) for words in lists])
    known = [c for c in total.values() if c]
    del lists, total
    release()
    sums = np.array([sum(known), len(known)], np.int64).tobytes()
    return pa.concat_tables(
        [answers, pa.table({"kind": ["sums"], "bucket": pa.array([-1], pa.int32()), "block": [-1], "payload": pa.array([sums], pa.binary())})]
    )


#: Subtrees are worked on together up to so many codes (the contexts below MET latest bytes may be more).
TOGETHER = 300_000


def _subtrees(table: pa.Table) -> tuple[np.ndarray, Iterator[Subtrees], list[np.ndarray]]:
    """A bucket's distinct codes, its subtrees some at a time, and each block's codes."""
    parts, counts = zip(*(unpack_codes(p.as_py()) for p in table.column("payload")), strict=True)
    codes, counted = add_up(list(parts), list(counts))
    met = codes >> 8 * (DEPTH + 1 - MET)
    ends = np.append(np.flatnonzero(met[1:] != met[:-1]) + 1, len(codes))

    def some() -> Iterator[Subtrees]:
        at = 0
        while at < len(codes):
            next_, last = np.searchsorted(ends, [at, at + TOGETHER], "right")
            end = int(ends[max(next_, last - 1)])
            yield Subtrees(codes[at:end], counted[at:end])
            at = end

    return codes, some(), list(parts)


def _roots(table: pa.Table) -> pa.Table:
    _, trees, _ = _subtrees(table)
    parts = [tree.roots() for tree in trees]
    keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.int64)])
    sums = np.concatenate([v for _, v in parts] or [np.zeros((3, 0))], 1)
    return pa.table({"key": pa.array(keys, pa.int64()), "a": sums[0], "b": sums[1], "pw": sums[2]})


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """Scores all whole texts, learning from those where `learn` is true.

    Returns doc_id (of any type), learned, n_tokens, n_known, train_tokens (long), base_score and score (log10, double). Tokens are
    words with A-Z lower-cased and one end per text; base_score is the add-one unigram score of the tokens, score the log10
    probability of the text's bytes and end under the context tree. A null text is empty (its end alone is scored), a
    null `learn` false; repeated rows are scored, and learned from, each; an empty table gives an empty result. Without
    texts to learn from, every byte has probability 2**-8.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size, learned = rows.agg(F.sum(F.octet_length("text")), F.sum(F.col("learn").cast("long"))).first()
    buckets = max(12, (size or 0) // BUCKET_BYTES)
    scan = stage(_scan(rows, buckets), "blocks")
    ends = int(learned or 0)
    asked = scan.select("kind", "bucket", "block", "payload")
    words = stage(asked.where("kind = 'word'").groupBy("bucket").applyInArrow(_count_words, ANSWER), "words")
    sums = [np.frombuffer(r.payload, np.int64) for r in words.where("block = -1").select("payload").toLocalIterator()]
    n = ends + sum(int(s[0]) for s in sums)
    v = (ends > 0) + sum(int(s[1]) for s in sums)
    codes = asked.where("kind = 'code'")
    roots = codes.groupBy("bucket").applyInArrow(_roots, "key long, a double, b double, pw double")
    summed = roots.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("a", "b", "pw"))).toArrow().sort_by("key")
    top = Top(summed.column("key").to_numpy(), np.stack([summed.column(c).to_numpy() for c in ("a", "b", "pw")]))
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def answer(table: pa.Table) -> pa.Table:
        codes, trees, parts = _subtrees(table)
        p = np.concatenate([tree.log_probabilities(shared.value).astype(np.float32) for tree in trees])
        release()
        return _answers("code", table, [zstandard.compress(p[np.searchsorted(codes, c)].tobytes()) for c in parts])

    answered = codes.groupBy("bucket").applyInArrow(answer, ANSWER)
    all_ = (
        scan.where("kind = 'text'")
        .unionAll(words.where("block >= 0").unionAll(answered).select("*", F.lit(None).cast(f"array<{any_type(docs)}>"), F.lit(None).cast("array<boolean>")))
    )
    return all_.groupBy("block").applyInArrow(
        _scorer(buckets, n, v, ends), f"doc_id {any_type(docs)}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _scorer(buckets: int, n: int, v: int, ends: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, bucket = table.column("kind").to_pylist(), table.column("bucket").to_pylist()
        row = kinds.index("text")
        texts = unpack_texts(table.column("payload")[row].as_py())
        ids, learn = table.column("doc_ids")[row].as_py(), table.column("learn")[row].as_py()
        counts: dict[bytes, int] = {}
        answers = {(k, b): zstandard.decompress(p.as_py()) for k, b, p in zip(kinds, bucket, table.column("payload"), strict=True) if k != "text"}
        distinct: set[bytes] = set()
        for t in texts:
            distinct.update(t.translate(LOWER).split())
        for b, words in dealt(distinct, buckets).items():
            counts.update(zip(words, np.frombuffer(answers.pop(("word", b)), np.int64).tolist(), strict=True))
        del distinct
        get, all_tokens = counts.__getitem__, float(np.log10(n + v + 1))
        tokens, known, base = [], [], []
        for t in texts:
            own = np.array([*map(get, t.translate(LOWER).split()), ends], np.int64)
            tokens.append(len(own))
            known.append(int((own > 0).sum()))
            base.append(float(np.log10(own + 1.0).sum() - len(own) * all_tokens))
        del counts
        codes, _ = block_codes(texts, [True] * len(texts))
        order, ranges = _dealt_codes(codes, buckets)
        p = np.zeros(len(codes))
        for b, at, end in ranges:
            p[order[at:end]] = np.frombuffer(answers.pop(("code", b)), np.float32)
        places = Lookup(codes)
        score = np.concatenate([_sums(some, places, p) for some in _slices(texts)]) / np.log(10.0)
        del places, codes, order, p, answers
        release()
        return pa.table(
            {
                "doc_id": pa.array(ids, table.schema.field("doc_ids").type.value_type),
                "learned": pa.array(learn, pa.bool_()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([n] * len(texts), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return run


class Lookup:
    """Places of codes in a sorted table of distinct ones, by a table of hashed places; the few that share a place are
    searched for."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.shift = np.uint64(64 - min(24, max(4, int(len(codes)).bit_length() + 2)))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(codes)] = np.arange(len(codes), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[self._slot(codes)].astype(np.int64)
        wrong = np.flatnonzero(self.codes[found] != codes)
        found[wrong] = np.searchsorted(self.codes, codes[wrong])
        return found


def _sums(texts: list[bytes], places: Lookup, p: np.ndarray) -> np.ndarray:
    """The sum of p over each text's bytes and end."""
    own = codes_of(texts)
    out = np.concatenate([p[places(own[at : at + (1 << 20)])] for at in range(0, len(own), 1 << 20)])
    return np.add.reduceat(out, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64))
