"""Benchmark decontamination with an FM-index per shard of the training text.

A shard (one Arrow batch of documents) is turned into a sequence of word numbers; windows of benchmark words are found by
backward search through the ranks of a wavelet matrix over its Burrows-Wheeler transform, and located by walking to sampled
suffix positions. Overlapping occurrences merge into removal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from gridloom.llm.common import ALNUM, any_type, discard, stage

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: So many bytes of benchmark, about, are looked for at a time; a larger one is dealt into parts, one pass over the documents each.
PART_BYTES = 4 << 20
SAMPLE = 8
SPANS, ITEMS = "gridloom_spans", "gridloom_items"


class WaveletMatrix:
    """Ranks of symbols in a sequence of small integers, a bit level at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low = np.zeros_like(at)
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            low = np.where(one, zeros + ones[low], low - ones[low])
        return at - low


class FMIndex:
    """Over word numbers from 1 to `symbols`; 0 ends a run of words and never matches."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]]) if not len(text) or text[-1] else text
        order = suffix_order(text)
        last = text[order - 1]  # of the first suffix: the end, which is 0
        bits = max(1, symbols.bit_length())
        self.wavelet = WaveletMatrix(last, bits)
        self.last = last
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << bits) + 1))])
        # Each sample-th place of the text is kept, and each start of a run, where a walk would have to stop.
        self.known = np.where((order % sample == 0) | (last == 0), order, -1)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of words, all of one length, the range of suffixes that start with it."""
        low = self.before[patterns[:, -1]]
        high = self.before[patterns[:, -1] + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            low, high = self.step(patterns[:, k], low), self.step(patterns[:, k], high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text places of suffixes, walking back to the next known one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(self.known[at] < 0)
        while len(open_):
            at[open_] = self.step(self.last[at[open_]], at[open_])
            steps[open_] += 1
            open_ = open_[self.known[at[open_]] < 0]
        return self.known[at] + steps


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes in order, by prefix doubling. Zeros count as different, earlier ones as smaller, so doubling ends
    after the logarithm of the longest run."""
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    width = 1
    n = len(text)
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        ahead = np.zeros(n, np.int64)
        if width > 1:
            ahead[: n - half] = rank[half:] + 1
            sorted_ahead = ahead[order]
            changed = (sorted_rank[1:] != sorted_rank[:-1]) | (sorted_ahead[1:] != sorted_ahead[:-1])
        else:
            changed = sorted_rank[1:] != sorted_rank[:-1]
        new[order] = np.concatenate([[0], np.cumsum(changed)])
        rank = new
        if n == 0 or int(rank.max()) == n - 1:
            return order
        half, width = width, width * 2
        ahead = np.zeros(n, np.int64)
        ahead[: n - half] = rank[half:] + 1
        order = np.argsort(rank * (n + 2) + ahead, kind="stable")


@dataclass
class Windows:
    """The benchmark's windows: word numbers by window length, and of each window the items, as the ends of its run in one
    array of item numbers."""

    words: dict[bytes, int]
    patterns: dict[int, np.ndarray]
    items: dict[int, tuple[np.ndarray, np.ndarray]]
    names: list[str]
    shortest: int


def windows_of(rows: Iterable[tuple[str | None, str | None]], width: int = 10) -> Windows:
    """All windows of `width` consecutive words of each (item, text); an item of fewer words, but not none, is one window.
    Items of one id count as one; a null id counts as the empty id."""
    words: dict[bytes, int] = {}
    names: dict[str, int] = {}
    found: dict[int, list[np.ndarray]] = {}  # the item's number stands after its words
    for item_id, text in rows:
        ids = np.array([words.setdefault(w, len(words) + 1) for w in (text or "").encode().translate(ALNUM).split()], np.int32)
        item = names.setdefault(item_id or "", len(names))
        if n := min(width, len(ids)):
            windows = np.lib.stride_tricks.sliding_window_view(ids, n)
            found.setdefault(n, []).append(np.concatenate([windows, np.full((len(windows), 1), item, np.int32)], 1))
    patterns, items = {}, {}
    for n, parts in found.items():
        every = np.unique(np.concatenate(parts), axis=0)
        first = np.flatnonzero(np.concatenate([[True], (every[1:, :-1] != every[:-1, :-1]).any(1)]))
        patterns[n], items[n] = every[first, :-1].astype(np.int64), (np.append(first, len(every)), every[:, -1])
    return Windows(words, patterns, items, list(names), min(patterns, default=0))


def parts_of(benchmark: DataFrame, width: int) -> Iterator[tuple[bool, Windows]]:
    """The benchmark's windows in parts of about PART_BYTES, and whether a part is the last."""
    small = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    many = max(1, -(-int(small.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    for k in range(many):
        part = small if many == 1 else small.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        yield k == many - 1, windows_of((tuple(r) for r in part.toLocalIterator()), width)


def occurrences(texts: list[bytes], windows: Windows) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
    """For one shard: the places of each text's first word in the sequence of all words (and the end), which words are
    hit, and the items found by text."""
    get = windows.words.get
    split = [t.translate(ALNUM).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    hit = np.zeros(total, bool)
    items: dict[int, set[int]] = {}
    if not windows.patterns or not total:
        return first, hit, items
    ids = np.fromiter((get(w, 0) for words in split for w in words), np.int64, total)
    # Runs of benchmark words within a text; shorter ones than the shortest window can't hold one.
    new = np.zeros(total + 1, bool)
    new[first[:-1][counts > 0]] = True
    inside = ids > 0
    begin = np.flatnonzero(inside & (new[:total] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (new[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    if total and inside[-1] and (not len(end) or end[-1] != total):
        end = np.append(end, total)
    kept = end - begin >= windows.shortest
    begin, end = begin[kept], end[kept]
    if not len(begin):
        return first, hit, items
    lengths = end - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1) + np.arange(int((lengths + 1).sum()))
    stops = np.cumsum(lengths + 1) - 1
    text = ids[np.minimum(at, total - 1)]
    text[stops] = 0
    index = FMIndex(text, len(windows.words))
    cover = np.zeros(total + 1, np.int64)
    for n, patterns in windows.patterns.items():
        low, high = index.search(patterns)
        many = np.maximum(high - low, 0)
        if not many.any():
            continue
        which = np.repeat(np.arange(len(patterns)), many)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        places = at[index.locate(rows)]
        np.add.at(cover, places, 1)
        np.add.at(cover, places + n, -1)
        where = np.searchsorted(first, places, "right") - 1
        ends, numbers = windows.items[n]
        for doc, window in set(zip(where.tolist(), which.tolist(), strict=True)):
            items.setdefault(doc, set()).update(numbers[ends[window] : ends[window + 1]].tolist())
    hit = np.cumsum(cover[:-1]) > 0
    return first, hit, items


Finish = Callable[[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray, dict[int, set[str]]], pa.RecordBatch]


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, finish: Finish, schema: StructType | str) -> DataFrame:
    """docs, searched for each part of the benchmark; finish() makes the result of a batch, its texts, the place of each
    one's first word, which words are hit, and the items by text. Between parts, what is found so far is written beside the rows."""
    names = docs.columns
    marked = StructType(docs.schema.fields[:]).add(SPANS, ArrayType(LongType())).add(ITEMS, ArrayType(StringType()))
    before = None
    for last, windows in parts_of(benchmark, width):
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last, again=before is not None) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                first, hit, numbers = occurrences(texts, windows)
                items = {k: {windows.names[i] for i in found} for k, found in numbers.items()}
                if again:
                    for k, (spans, known) in enumerate(zip(batch.column(SPANS).to_pylist(), batch.column(ITEMS).to_pylist(), strict=True)):
                        for begin, end in zip(spans[::2], spans[1::2], strict=True):
                            hit[first[k] + begin : first[k] + end] = True
                        if known:
                            items.setdefault(k, set()).update(known)
                own = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
                if last:
                    yield finish(own, texts, first, hit, items)
                else:
                    edges = [np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))) for a, b in zip(first[:-1], first[1:], strict=True)]
                    more = [pa.array(edges, pa.list_(pa.int64())), pa.array([sorted(items.get(k, ())) for k in range(len(texts))], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*names, SPANS, ITEMS])

        if last:
            return docs.mapInArrow(scan, schema)
        docs = stage(docs.mapInArrow(scan, marked), "marked")
        if before is not None:
            discard(before)
        before = docs
    raise AssertionError("no part is the last")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id (of any type), n_words, n_hit (words inside any occurrence of a window) and items (the sorted
    ids found).

    Words are lower-cased runs of letters, digits and non-ASCII characters. A null or empty text has no words; repeated
    rows give repeated results; an empty benchmark hits nothing. Nothing is shuffled; a benchmark of more than PART_BYTES
    is searched for part by part, each pass written to the shared folder.
    """

    def finish(batch: pa.RecordBatch, texts: list[bytes], first: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
        hits = np.concatenate([[0], np.cumsum(hit)])
        found = pa.array([sorted(items.get(k, ())) for k in range(len(texts))], pa.list_(pa.string()))
        counts = [pa.array(np.diff(first), pa.int64()), pa.array(hits[first[1:]] - hits[first[:-1]], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, found], names=["doc_id", "n_words", "n_hit", "items"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _searched(rows, benchmark, width, finish, f"doc_id {any_type(rows)}, n_words long, n_hit long, items array<string>")


def removal_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges from the first to the last word of each run of hit words."""
    spans: list[tuple[int, int]] = []
    previous = False
    for match, now in zip(WORD.finditer(text.lower()), hit, strict=True):
        if now and previous:
            spans[-1] = (spans[-1][0], match.end())
        elif now:
            spans.append(match.span())
        previous = bool(now)
    return spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with the removal spans cut from the texts and n_chars, if there, counted anew; other columns as they are.

    Each maximal run of hit words goes, from its first word to its last. A document without hits, null texts included,
    stays as it is; no row goes.
    """
    names = docs.columns

    def cut(batch: pa.RecordBatch, texts: list[bytes], first: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
        if not items:
            return batch
        new = batch.column("text").to_pylist()
        chars = batch.column("n_chars").to_pylist() if "n_chars" in names else None
        for k in items:
            parts, at = [], 0
            for begin, end in removal_spans(texts[k], hit[first[k] : first[k + 1]]):
                parts.append(texts[k][at:begin])
                at = end
            new[k] = b"".join([*parts, texts[k][at:]]).decode()
            if chars is not None:
                chars[k] = len(new[k])
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array(new, batch.schema.field("text").type)
        if chars is not None:
            columns["n_chars"] = pa.array(chars, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return _searched(docs, benchmark, width, cut, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query, from contamination()'s."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
