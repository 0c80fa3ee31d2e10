"""I-Match fingerprints: which terms of a lexicon a document has, hashed for several random subsets of the lexicon.

The lexicon is a band of inverse document frequency. Its rarer end is a share of all documents, so the lexicon has at most
(mean distinct terms of a document) / share terms, whatever the number of documents; that bound makes it broadcastable.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import ALNUM, stage


@dataclass(frozen=True)
class Band:
    """Terms in at least max(2, rare * documents) and at most common * documents documents. Of the random subsets of
    the lexicon, as many as `each` hold a share of 1/r of the terms, for each r of `rates`: large ones tell long texts
    apart, small ones survive edits."""

    rare: float = 0.001
    common: float = 0.2
    rates: tuple[int, ...] = (3, 6, 12, 24, 48, 96, 192, 384, 768)
    each: int = 7


#: Distinct terms of so many bytes of text meet in one bucket; documents of so many in one range of doc_ids.
BUCKET_BYTES = 48 << 20
RANGE_BYTES = 16 << 20
#: Ranges are cut in two steps, of so many each.
FINE = 1024


def terms(text: bytes) -> set[bytes]:
    """Distinct words: lower-cased runs of letters, digits and non-ASCII characters."""
    return set(text.translate(ALNUM).split())


def subsets_of(term: bytes, band: Band) -> tuple[int, ...]:
    """The random subsets that a term belongs to, by its hash alone."""
    return tuple(k for k in range(len(band.rates) * band.each) if xxhash.xxh64_intdigest(term, k + 1) % band.rates[k // band.each] == 0)


def signature(text: bytes, lexicon: dict[bytes, tuple[int, ...]], band: Band) -> list[int]:
    """A hash of the sorted terms for the whole lexicon and for each subset; 0 where a text has none of the terms. A
    text without any term of the lexicon has the hash of its bytes first instead."""
    found = sorted(terms(text) & lexicon.keys())
    chosen: list[list[bytes]] = [[] for _ in range(len(band.rates) * band.each)]
    for t in found:
        for k in lexicon[t]:
            chosen[k].append(t)
    first = xxhash.xxh32_intdigest(b" ".join(found), 1) if found else xxhash.xxh32_intdigest(text, 2)
    return [first or 1, *((xxhash.xxh32_intdigest(b" ".join(c), 3) or 1) if c else 0 for c in chosen)]


def likeness(a: list[int], b: list[int]) -> float:
    """Of the hashes that either text has, the share that both have."""
    either = sum(x or y for x, y in zip(map(bool, a), map(bool, b), strict=True))
    return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / either


def shown(signature: list[int]) -> str:
    return "".join(f"{x:08x}" for x in signature)


def document_frequencies(docs: DataFrame, total_bytes: int, least: int, most: float) -> DataFrame:
    """Terms in at least `least` and at most `most` documents, with the number of documents: term binary, df long.

    Each batch of documents counts its own terms and sends sorted, compressed lists to buckets."""
    buckets = max(12, total_bytes // BUCKET_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df: Counter[bytes] = Counter()
            for text in batch.column("text").cast(pa.binary()):
                df.update(terms(text.as_py() or b""))
            lists: dict[int, list[bytes]] = {}
            for t in sorted(df):
                lists.setdefault(zlib.crc32(t) % buckets, []).append(t)
            rows = [(k, zstandard.compress(np.array([len(x), *(df[t] for t in x)], np.int64).tobytes() + b" ".join(x), 3)) for k, x in lists.items()]
            if rows:
                k, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    def add(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for packed in table.column("packed"):
            data = zstandard.decompress(packed.as_py())
            n = int(np.frombuffer(data, np.int64, 1)[0])
            for t, c in zip(data[8 * (n + 1) :].split(b" "), np.frombuffer(data, np.int64, n, 8).tolist(), strict=True):
                total[t] = total.get(t, 0) + c
        kept = [(t, c) for t, c in total.items() if least <= c <= most]
        return pa.table({"term": pa.array([t for t, _ in kept], pa.binary()), "df": pa.array([c for _, c in kept], pa.int64())})

    return docs.select("text").mapInArrow(count, "bucket int, packed binary").groupBy("bucket").applyInArrow(add, "term binary, df long")


def lexicon_of(docs: DataFrame, band: Band = Band()) -> dict[bytes, tuple[int, ...]]:
    """The lexicon of all documents, and each term's subsets; see Band for its bound."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    least = max(2, int(np.ceil(band.rare * n)))
    found = document_frequencies(texts, size or 0, least, band.common * n).select("term").toLocalIterator()
    return {(t := bytes(r.term)): subsets_of(t, band) for r in found}


def _ranges(rows: DataFrame, many: int) -> list[int]:
    """Greatest doc_ids of about `many` ranges of like size, sorted: first of up to FINE ranges, then within each. The cuts
    within one range are made where its ids are; the driver gets 8 bytes for RANGE_BYTES of text."""
    def cuts(n: int):
        return F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)

    ids = rows.select("doc_id").where("doc_id is not null")
    coarse = min(many, FINE)
    if coarse < 2:
        return []
    found = ids.agg(cuts(coarse)).first()[0] or []
    fine = -(-many // coarse)
    if fine > 1:
        edges = np.array(sorted(set(found)), np.int64)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.searchsorted(edges, batch.column("doc_id").to_numpy(), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at)], names=["doc_id", "range"])

        within = ids.mapInArrow(number, "doc_id long, range int").groupBy("range").agg(cuts(fine).alias("cuts"))
        found = [*found, *(c for r in within.collect() for c in r["cuts"])]  # up to FINE rows
    return sorted(set(found))


def _following(heads: DataFrame) -> DataFrame:
    """From (range, head): each range's head with the range before it (to), the last for the first. Ranges are looked at by
    blocks of FINE, and blocks by one row each, so no task orders all of them."""
    block = F.floor(F.col("range") / FINE)
    blocks = heads.groupBy(block.alias("block")).agg(F.max("range").alias("last"))
    whole = blocks.agg(F.max("last").alias("end"))
    blocks = blocks.select("block", F.lag("last").over(Window.orderBy("block")).alias("earlier"))
    near = F.lag("range").over(Window.partitionBy("block").orderBy("range"))
    found = heads.withColumn("block", block).withColumn("near", near).join(blocks, "block").join(F.broadcast(whole))  # one row
    return found.select(F.coalesce("near", "earlier", "end").alias("to"), "head")


def fingerprints(docs: DataFrame, band: Band = Band()) -> DataFrame:
    """Per row: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's, in descending order of doc_id (null last, then the text's hash); the first follows the last. A null text
    is empty. Equal texts have equal fingerprints. Likeness is the share of equal subset hashes. A single document follows
    itself; of equal rows each has the other, or the following document, as next. An empty table gives an empty result. A
    doc_id is an integer (text of one is read as it; any other raises).

    Documents move once, compressed, to ranges of doc_id; each range also gets the first document of the one after it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not n:
        return spark.createDataFrame([], out)
    lexicon = spark.sparkContext.broadcast(lexicon_of(docs, band))
    # Range 0 has the greatest doc_ids; the last has the least, and null.
    edges = spark.sparkContext.broadcast(np.array(_ranges(rows, max(1, (size or 0) // RANGE_BYTES)), np.int64))

    def number(ids: list[int | None]) -> list[int]:
        at = np.searchsorted(edges.value, np.array([i if i is not None else -(2**63) for i in ids], np.int64), "left")
        return [len(edges.value) - int(k) if i is not None else len(edges.value) for k, i in zip(at, ids, strict=True)]

    def range_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(number(batch.column("doc_id").to_pylist()), pa.int32())], names=["doc_id", "hash", "range"])

    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash"))
    heads = rows.select("doc_id", "hash").mapInArrow(range_only, "doc_id long, hash long, range int").groupBy("range").agg(first.alias("head"))
    heads = stage(_following(heads).select("to", F.struct("head.doc_id").alias("id"), F.col("head.hash").alias("hash")), "heads")
    # A struct of a null is not null. Where the heads are few, Spark broadcasts them.
    carried = rows.withColumn("id", F.struct("doc_id")).join(heads, ["id", "hash"]).select("doc_id", "hash", "text", "to")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            given = batch.column("to").to_pylist()
            own = number(batch.column("doc_id").to_pylist())
            columns = [
                pa.array([k if t is None else t for k, t in zip(own, given, strict=True)], pa.int32()),
                pa.array([t is not None for t in given]),
                batch.column("doc_id"),
                batch.column("hash"),
                pa.array([pack(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "head", "doc_id", "hash", "packed"])

    def mark(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        ids, hashes, head = (table.column(c).to_pylist() for c in ("doc_id", "hash", "head"))
        order = sorted(range(len(ids)), key=lambda k: (head[k], ids[k] is None, -(ids[k] or 0), -hashes[k]))
        own = [k for k in order if not head[k]]
        packed = table.column("packed")
        result: list[tuple] = []
        text = unpack(packed[own[0]].as_py())
        mine = signature(text, lexicon.value, band)
        for at, k in enumerate(own):
            following = order[at + 1]
            next_text = unpack(packed[following].as_py())
            next_mine = signature(next_text, lexicon.value, band)
            chars, next_chars = text.decode(), next_text.decode()
            half = len(chars) // 2
            edited = (chars[: len(chars) - half] + next_chars[:half]).encode()
            theirs = signature(edited, lexicon.value, band)
            result.append((ids[k], len(chars), hashlib.sha256(edited).hexdigest(), shown(mine), shown(theirs), likeness(mine, theirs), likeness(mine, next_mine)))
            text, mine = next_text, next_mine
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*result, strict=True), types, strict=True)], names=names)

    both = rows.select("doc_id", "hash", "text", F.lit(None).cast("int").alias("to")).unionAll(carried)
    return both.mapInArrow(deal, "range int, head boolean, doc_id long, hash long, packed binary").groupBy("range").applyInArrow(mark, out)
