"""Best-fit packing of tokenised documents into sequences of a fixed length, by a linear grouping scheme.

The lengths are grouped and packed as a histogram (at most one entry for each length up to the capacity), so what the
driver handles doesn't grow with the number of documents. Documents then take the slots of their length by rank.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import LOWER, stage

CACHED_WORDS = 400_000


#: How byte-level tokenizers show a byte: printable Latin-1 as itself, the others, in order, from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_SHOWN = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}


class _Packers(dict):
    def __missing__(self, n: int):
        self[n] = struct.Struct(f"<{n}I").pack
        return self[n]


_PACK = _Packers()


#: How the special tokens of the vocabulary start.
SPECIAL = b"<|"


class _Ids(dict):
    """Ids, as little-endian 32-bit bytes, of what stands between white space; forgets all when full.

    A word of letters alone that is already in lower case and normal form passes the tokenizer's normaliser and splitter
    unchanged, so it goes to its BPE model directly; a full stop or comma after a letter is always a token of its own.
    Everything else is encoded by the whole tokenizer. Special tokens are looked for before letters are lower-cased, so
    what may hold one (it would start with SPECIAL) keeps its case.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = {mark: self.whole(mark) for mark in (b".", b",")}

    def text(self, raw: bytes) -> bytes:
        words = raw.translate(LOWER).split()
        if SPECIAL in raw:
            words = [w if SPECIAL in w else low for w, low in zip(raw.split(), words, strict=True)]
        return b"".join(map(self.__getitem__, words))

    def whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def modelled(self, word: bytes) -> bytes:
        shown = word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_SHOWN)
        return _PACK[len(tokens := self.tokenize(shown))](*[t.id for t in tokens])

    def __missing__(self, word: bytes) -> bytes:
        if (mark := self.marks.get(word[-1:])) and word[-2:-1].isalpha():
            return self[word[:-1]] + mark
        if word.isalpha() or ((text := word.decode()).isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)):
            ids = self.modelled(word)
        else:
            ids = self.whole(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids


_CACHES: dict[str, _Ids] = {}


def _ids_of(tokenizer_path: str) -> _Ids:
    if tokenizer_path not in _CACHES:
        _CACHES[tokenizer_path] = _Ids(tokenizer_path)
    return _CACHES[tokenizer_path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32.

    A document is the tokenizer's ids of its whole text, then `end_id`; a null or empty text is `end_id` alone. Only
    documents longer than `capacity` are cut, each piece but the last having exactly `capacity` ids. The tokenizer must
    be word_bpe_49k or alike: byte-level BPE that ignores white space and letter case and splits letters from others.
    Ids are looked up by white-space separated chunk.
    Repeated rows each get their own pieces; a doc_id is of any type, a null one stays null; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = _ids_of(tokenizer_path), np.array([end_id], "<u4").tobytes()
        size = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                data = ids.text(text.as_py() or b"") + end
                for k, at in enumerate(range(0, len(data), size)):
                    part = data[at : at + size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    # A repeated name would be ambiguous; only these two columns travel to Python.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


@dataclass
class _Bins:
    """`count` sequences that hold the same lengths: (length, copies) in order of placement."""

    count: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def split(self, count: int) -> _Bins:
        self.count -= count
        return _Bins(count, self.room, list(self.items))

    def put(self, length: int, copies: int = 1) -> None:
        self.room -= length * copies
        if self.items and self.items[-1][0] == length:
            self.items[-1] = (length, self.items[-1][1] + copies)
        else:
            self.items.append((length, copies))


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes, each with how often it is used: the linear relaxation by column generation, rounded
    down. What rounding leaves over is at most one sequence's content for each size."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    x = need / np.diag(basis)
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        best, column = _knapsack(sizes, price, capacity)
        if best <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].round().astype(int), int(x[j] + 1e-6)) for j in range(n)]


def _knapsack(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration within the capacity (any number of each size)."""
    best = np.zeros(capacity + 1)
    picked = np.full(capacity + 1, -1)
    for k, (size, worth) in enumerate(zip(sizes, value, strict=True)):
        if worth <= 1e-12:
            continue
        for _ in range(capacity // size):  # at most so many further copies help
            with_one = best[:-size] + worth
            better = np.flatnonzero(with_one > best[size:] + 1e-12)
            if not len(better):
                break
            best[better + size] = with_one[better]
            picked[better + size] = k
    column = np.zeros(len(sizes))
    at, worth = int(np.argmax(best)), float(best.max())
    room = at
    while room > 0 and picked[room] >= 0:
        column[picked[room]] += 1
        room -= sizes[picked[room]]
    return float(column @ value) if worth > 0 else 0.0, column


def plan(histogram: dict[int, int], capacity: int = 4096, groups: int = 24, small: float = 1 / 8) -> list[_Bins]:
    """Packs a histogram of lengths (1 to capacity) into sequences.

    Lengths above small * capacity, the large ones, are sorted and cut into `groups` groups of equal cardinality; each
    is rounded up to its group's largest length. The configurations of these few sizes are optimised; actual lengths then
    take the rounded slots, so each configuration only gets more room. What is left over, and then the small lengths,
    longest first, go to the sequence with least sufficient room (best fit), or to a new one. An empty histogram gives
    no sequences.
    """
    counts = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    bins: list[_Bins] = []
    if c := counts.pop(capacity, 0):
        bins.append(_Bins(c, 0, [(capacity, 1)]))
    large = [(n, c) for n, c in counts.items() if n > small * capacity]
    rest = [(n, c) for n, c in counts.items() if n <= small * capacity]
    total = sum(c for _, c in large)
    # Runs of one length within each group, longest first.
    queues: list[list[list[int]]] = []
    share, filled = max(1, -(-total // groups)), 0
    for n, c in large:
        while c:
            if filled % share == 0 and (not queues or sum(r[1] for r in queues[-1]) >= share):
                queues.append([])
            if not queues:
                queues.append([])
            take = min(c, share - sum(r[1] for r in queues[-1]))
            queues[-1].append([n, take])
            filled += take
            c -= take
    merged: dict[int, list[list[int]]] = {}
    for q in queues:  # groups whose largest length is the same are one size
        merged.setdefault(q[0][0], []).extend(q)
    sizes = sorted(merged, reverse=True)
    if sizes:
        demand = [sum(r[1] for r in merged[s]) for s in sizes]
        for column, times in _configurations(sizes, demand, capacity):
            slots = [s for s, k in zip(sizes, column, strict=True) for _ in range(k)]
            while times and slots:
                heads = [merged[s] for s in slots]
                if any(not h for h in heads):
                    break
                # So many sequences alike until some slot's run of one length ends.
                uses = {s: slots.count(s) for s in set(slots)}
                run = min([times, *(merged[s][0][1] // uses[s] for s in uses)])
                if run == 0:
                    # A run shorter than the slots of its size: one sequence takes what comes next.
                    if any(sum(r[1] for r in merged[s]) < k for s, k in uses.items()):
                        break
                    run = 1
                one = _Bins(run, capacity)
                for s in slots:
                    head = merged[s][0]
                    one.put(head[0])
                    head[1] -= run
                    if head[1] == 0:
                        merged[s].pop(0)
                bins.append(one)
                times -= run
        left: dict[int, int] = {}
        for q in merged.values():
            for n, c in q:
                left[n] = left.get(n, 0) + c
        rest = sorted([(n, c) for n, c in left.items() if c] + rest, reverse=True)
    _best_fit(bins, rest, capacity)
    return bins


def _best_fit(bins: list[_Bins], lengths: list[tuple[int, int]], capacity: int) -> None:
    by_room: dict[int, list[_Bins]] = {}
    rooms: list[int] = []  # sorted rooms that have sequences

    def add(b: _Bins) -> None:
        if b.room not in by_room:
            bisect.insort(rooms, b.room)
        by_room.setdefault(b.room, []).append(b)

    for b in bins:
        add(b)
    for n, c in lengths:
        while c:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                new = _Bins(max(1, c // (capacity // n)), capacity)
                bins.append(new)
                add(new)
                continue
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            copies = min(room // n, c)
            many = min(b.count, c // copies)
            if many < b.count:
                part = b.split(many)
                bins.append(part)
                add(b)
                b = part
            b.put(n, copies)
            c -= many * copies
            add(b)


def slots(bins: list[_Bins]) -> dict[str, np.ndarray]:
    """The plan as runs of slots, by length and rank within it: a run covers `count` ranks from `at` (ranks of all
    lengths numbered through, shorter lengths first), in sequences from `sequence` on, at `offset` there."""
    rows = []
    sequence = 0
    for b in bins:
        offset = 0
        for n, copies in b.items:
            for _ in range(copies):
                rows.append((n, sequence, offset, b.count))
                offset += n
        sequence += b.count
    rows.sort()
    length, first, offset, count = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 4))
    return {"length": length, "sequence": first, "offset": offset, "at": np.concatenate([[0], np.cumsum(count)])[: len(rows)].astype(np.int64)}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, groups: tuple[int, ...] = (24, 48, 96)) -> DataFrame:
    """Packs all documents; one row per piece with sequence_id and offset. See pieces() and plan() for the rules.

    Of the plans for each number of groups, the one with fewest sequences is taken.
    Ranks within a length are dealt over buckets, so a length that a third of all pieces share isn't ranked by one task.
    Equal rows may swap slots between runs; any such choice is valid. An empty table gives an empty result.
    """
    cut = stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    run = slots(min((plan(histogram, capacity, g) for g in groups), key=lambda bins: sum(b.count for b in bins)))
    before = np.zeros(capacity + 2, np.int64)
    for n, c in histogram.items():
        before[n + 1] = c
    before = np.cumsum(before)
    buckets = max(64, sum(histogram.values()) // 50_000)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counted = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(offsets, ["length", "bucket"])
    shared = docs.sparkSession.sparkContext.broadcast((run, before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, before = shared.value
        for batch in batches:
            length, rank, base = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank", "base"))
            at = before[length] + base + rank - 1
            k = np.searchsorted(run["at"], at, "right") - 1
            placed = [pa.array(run["sequence"][k] + at - run["at"][k]), pa.array(run["offset"][k])]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *placed], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
