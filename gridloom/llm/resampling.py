"""Importance resampling towards a target's distribution, by hashed word n-grams.

Two passes over the texts: one counts hashed n-grams of the corpus and of the target, and an array of 10,000 log-ratios, the gains, comes of
that; the other sums the gains of each text and adds noise from its id, so that the highest scores are a weighted draw without
replacement. Scores are whole numbers. Their histogram, added up from above, gives the cutoff and each score's first rank; only within a
score rows are numbered.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from gridloom.llm.common import LOWER, LOWER_TABLE, NOT_ALNUM, release, stage

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: So many bytes are worked on at a time (some 60 bytes of temporary arrays for each).
PIECE = 1 << 20
#: Words up to this length are hashed byte by byte for all words at once, longer ones one by one.
SHORT = 48
#: The histogram's upper level has at most so many bins; it is all that the driver sees of the scores.
BINS = 1 << 14


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def _advance(register: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(register ^ byte) & 255] ^ (register >> np.uint32(8))


def continued(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 values continued by the bytes buffer[start:end], each its own."""
    out = ~crc
    lengths = ends - starts
    long = np.flatnonzero(lengths > SHORT)
    left = np.where(lengths > SHORT, 0, lengths).astype(np.uint8)
    order = np.argsort(SHORT - left, kind="stable")  # longest first, a radix sort on bytes
    register, first = out[order], starts[order]
    counts = len(order) - np.cumsum(np.bincount(left, minlength=SHORT + 1))
    for k in range(SHORT):
        n = int(counts[k])
        if not n:
            break
        register[:n] = _advance(register[:n], buffer[first[:n] + k])
    out[order] = register
    out = ~out
    for i in long.tolist():
        out[i] = zlib.crc32(buffer[starts[i] : ends[i]].tobytes(), int(crc[i]))
    return out


def _words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff((~NOT_ALNUM[buffer]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(texts: list[bytes], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts lower-cased in buffers of about `size` bytes, each ended by a line feed: the buffer, the texts' numbers with the ends of
    their parts, as rows (number, end), and how many of the first words were there before. A long text is cut between words, and each
    part but the first begins with the last words of the one before, of which the n-grams that end there are counted already."""
    size = size or PIECE
    pending, marks, used = [], [], 0
    for k, text in enumerate(texts):
        if used and used + len(text) > size:
            yield LOWER_TABLE[np.frombuffer(b"".join(pending), np.uint8)], np.array(marks), 0
            pending, marks, used = [], [], 0
        if len(text) <= size:
            used += len(text) + 1
            pending.append(text + b"\n")
            marks.append((k, used))
            continue
        carried, at, text = b"", 0, text.translate(LOWER)
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and not NOT_ALNUM[text[end]]:
                end += 1
            part = np.frombuffer(carried + b" " + text[at:end] + b"\n", np.uint8)
            old = len(_words(np.frombuffer(carried, np.uint8))[0])
            yield part, np.array([(k, len(part))]), old
            starts, _ = _words(part)
            carried = part[starts[-(LONGEST - 1)] if len(starts) >= LONGEST - 1 else 0 :].tobytes().strip() if len(starts) else b""
            at = end
    if pending:
        yield LOWER_TABLE[np.frombuffer(b"".join(pending), np.uint8)], np.array(marks), 0


def features(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: the numbers of the texts, how many words of each there are, and a row (place among these numbers, bucket) for
    each n-gram of one to LONGEST words, repeats and all."""
    for buffer, marks, old in pieces(texts):
        starts, ends = _words(buffer)
        place = np.searchsorted(marks[:, 1], starts, "right")
        new = np.ones(len(starts), bool)
        new[:old] = False
        crc = np.zeros(len(starts), np.uint32)
        rows = []
        for n in range(1, LONGEST + 1):
            if len(starts) < n:
                break
            if n > 1:
                # The n-grams that were one word shorter go on by a space and the word after them.
                keep = place[: len(place) - n + 1] == place[n - 1 :]
                crc = ~_advance(~crc[: len(keep)], np.uint32(32))
            else:
                keep = np.ones(len(starts), bool)
            crc = continued(buffer, starts[n - 1 :], ends[n - 1 :], crc)
            counted = keep & new[n - 1 :]
            rows.append(np.stack([place[n - 1 :][counted], crc[counted].astype(np.int64) % buckets]))
        found = np.concatenate(rows, 1) if rows else np.zeros((2, 0), np.int64)
        yield marks[:, 0], np.bincount(place[new], minlength=len(marks)), found


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. A task adds up its own; `buckets` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(_texts(batch), buckets):
                total += np.bincount(found[1], minlength=buckets)
            release()
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(total[kept])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket a thousand times the logarithm of its share in the target over that in the corpus, one added to each count,
    rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda a, b: (float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(label: str) -> int:
    """A thousandth part Gumbel variate of a label, as a whole number: from the first 32 bits of its SHA-256."""
    h = int(hashlib.sha256(label.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """Per document doc_id, n_words, n_features, weight (the sum of its n-grams' gains) and score (weight and noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket
    names = ["n_words", "n_features", "weight", "score"]
    schema = StructType([docs.schema["doc_id"]])
    for name in names:
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            texts = _texts(batch)
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for numbers, words, (place, bucket) in features(texts, len(gains)):
                n_words[numbers] += words
                n_features[numbers] += np.bincount(place, minlength=len(numbers))
                total = np.zeros(len(numbers), np.int64)
                np.add.at(total, place, gains[bucket])
                weight[numbers] += total
            ids = batch.column("doc_id").cast(pa.string()).to_pylist()
            drawn = np.array([noise(f"{seed}:{'' if i is None else i}") for i in ids], np.int64)
            release()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (n_words, n_features, weight, weight + drawn))], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, score, ...) with rank: of the N eligible rows the floor(percent * N / 100) highest scores are numbered from 1, ties
    in order of doc_id, null last; rank is null elsewhere. `scored` is read several times, so it should be a table.

    The driver sees the number of rows in at most BINS ranges of scores, and with that the range of the cutoff and how many rows lie above
    each range. Within a range the counts of its scores are added up, and within a score equal rows are counted and the others numbered."""
    rows = scored.withColumn("gridloom_in", eligible)
    inside = rows.where("gridloom_in")
    n, low, high = inside.agg(F.count("*"), F.min("score"), F.max("score")).first()
    wanted = percent * n // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    width = (high - low) // BINS + 1
    bin_of = F.floor((F.col("score") - low) / width).cast("long")  # exact: both are whole numbers below 2 ** 53
    bins = {r["bin"]: r["n"] for r in inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()}  # at most BINS
    above, at = {}, 0
    for b in sorted(bins, reverse=True):
        above[b], at = at, at + bins[b]
        if at >= wanted:
            break
    last = min(above)  # the cutoff lies in this range
    spark = scored.sparkSession
    offsets = F.broadcast(spark.createDataFrame([(b, k) for b, k in above.items()], "gridloom_bin long, gridloom_above long"))  # at most BINS rows
    chosen = inside.withColumn("gridloom_bin", bin_of).where(F.col("gridloom_bin") >= last)
    scores = chosen.groupBy("gridloom_bin", "score").agg(F.count("*").alias("gridloom_n")).join(offsets, "gridloom_bin")
    higher = Window.partitionBy("gridloom_bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.withColumn("gridloom_offset", F.col("gridloom_above") + F.coalesce(F.sum("gridloom_n").over(higher), F.lit(0)))
    scores = scores.where(F.col("gridloom_offset") < wanted).select("score", "gridloom_offset")
    columns = scored.columns
    equal = chosen.groupBy(*columns).agg(F.count("*").alias("gridloom_n"))
    # Every row of a surviving score is there, so the offset is the number of rows of higher scores.
    placed = equal.join(scores, "score", "left")
    rest = [F.asc_nulls_last(c) for c in columns if c not in ("doc_id", "score")]
    earlier = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), *rest).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("gridloom_first", F.col("gridloom_offset") + F.coalesce(F.sum("gridloom_n").over(earlier), F.lit(0)))
    placed = placed.withColumn("gridloom_k", F.explode(F.sequence(F.lit(1), F.col("gridloom_n"))))
    rank = F.col("gridloom_first") + F.col("gridloom_k")
    ranked = placed.select(*columns, F.when(rank <= wanted, rank).cast("long").alias("rank"))
    left = rows.where(~F.col("gridloom_in") | (bin_of < last)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionAll(left)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_words, n_features, weight, score and rank. Drawn, and so ranked, are floor(percent * N / 100)
    of the N documents of at least `least_words` words: those of the highest scores, ties by doc_id, null last.

    A null text has no words; neither has an empty one: their weight is 0. A null doc_id has the noise of an empty one. Rows that repeat
    whole have one score and consecutive ranks. Other columns are ignored. With an empty target, gains are those of a target without
    n-grams; an empty table gives no rows. Texts of any length are read in pieces."""
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    return draw(stage(weigh(docs, gains, seed), "resample-scores"), F.col("n_words") >= least_words, percent)


_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _grams(table: str, key: str) -> str:
    words = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"SELECT k, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT {key} AS k, {words} AS w FROM {table}), (SELECT unnest(range(1, {LONGEST + 1})) AS n) WHERE len(w) >= n)"


ORACLE = f"""
WITH t AS (SELECT {_TABLE} AS tab),
d AS MATERIALIZED ({_grams("documents", "doc_id")}), e AS MATERIALIZED ({_grams("benchmark", "0")}),
c AS MATERIALIZED (SELECT g, {_CRC} % {BUCKETS} AS b FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM d UNION SELECT g FROM e)), t),
s AS (SELECT b, count(*) AS s FROM d JOIN c USING (g) GROUP BY b), q AS (SELECT b, count(*) AS t FROM e JOIN c USING (g) GROUP BY b),
gain AS (SELECT i.b, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM q), 0) + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS b) i LEFT JOIN s ON s.b = i.b LEFT JOIN q ON q.b = i.b),
w AS (SELECT k, count(*) AS n, sum(gain) AS weight FROM d JOIN c USING (g) JOIN gain USING (b) GROUP BY k),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN w ON w.k = doc_id),
o AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS * 3 - 3} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS * 3 - 3} ORDER BY score DESC, doc_id) END AS rank, count(*) FILTER (WHERE n_features >= {LEAST_WORDS * 3 - 3}) OVER () AS n FROM r)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, (CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END)::BIGINT AS rank FROM o
"""
