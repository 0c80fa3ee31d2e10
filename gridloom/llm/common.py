"""What several operators of this subpackage share: tables, staged tables, and byte-level tokenising."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Maps A-Z to a-z, keeps 0-9, a-z and all bytes of multi-byte characters; everything else becomes a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. Without either,
    a temporary folder in local mode, where all run on one machine; on a cluster ValueError."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    # Small row groups, so writing large blobs doesn't hold 128 MB in each task.
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._gridloom_path = path
    return found


def discard(*staged: DataFrame) -> None:
    """Removes what stage() has written, once nothing that is still to be computed reads it."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files that no plan refers to any more. It does so when the driver's JVM collects
    garbage, which a driver with little to do puts off while the executors' disks fill."""
    spark._jvm.System.gc()


#: Over so many tasks the rows of one key are dealt in join_one(), if their number isn't known.
SALTS = 8
#: So many rows of a key make a salt, where it is.
SALT_ROWS, MOST_SALTS = 256, 4096


def salts_of(n: Column) -> Column:
    """Over how many tasks to deal n rows of one key."""
    return F.least(F.ceil(n / SALT_ROWS), F.lit(MOST_SALTS)).cast("int")


def join_one(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: str | None = None) -> DataFrame:
    """many joined with one, which has one row a key: that row is repeated, and the rows of `many` are dealt over the copies
    by a hash of their columns `by`, so a frequent key isn't met in one task. There are SALTS copies, or as many as the column
    `salts`, the same in both tables for a key, says."""
    salt = "gridloom_salt"
    copies = F.col(salts) if salts else F.lit(SALTS)
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(*by), copies).cast("int"))
    spread = one.withColumn(salt, F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(spread.drop(salts) if salts else spread, [*keys, salt], how).drop(salt)


def any_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The column's type, as in a schema string."""
    return docs.schema[column].dataType.simpleString()


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's decimal text, modulo `modulus`; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """Gives freed memory back to the machine; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(buffer: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes that aren't separators.

    The hash is a polynomial of the run's bytes modulo 2**64 from one pass over the buffer, so no Python object is made
    for a word.
    """
    n = len(buffer)
    word = ~is_space[buffer]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    # Each byte is scrambled and multiplied by a power that depends on its place in the word alone.
    place = np.arange(n, dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
    powers = _powers(int((ends - starts).max()) + 1)
    np.minimum(place, len(powers) - 1, out=place)
    value = (BYTE_VALUES[buffer] * powers[place]) * word
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    sums = total[ends] - total[starts]
    return starts, ends, mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, 0x2545F4914F6CDD1D, np.uint64)]))
    return _POWERS


SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)]] = True
LOWER_TABLE = np.frombuffer(LOWER, np.uint8)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a list lower-cased in one buffer, each ended by a line feed, and the offsets of their starts."""
    buffer = LOWER_TABLE[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return buffer, np.concatenate([[0], np.cumsum(lengths)])


#: So many bytes are hashed at a time, which bounds the temporary arrays (some 40 bytes for each).
SLICE = 1 << 20


def hashed_words(texts: list[bytes], is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word of a list of texts, in order. Long texts are hashed piece by piece, cut at
    separators, so memory doesn't follow the longest text (but its longest word)."""
    docs: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    pending: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            buffer, offsets = joined(pending)
            starts, _, found = word_hashes(buffer, is_space)
            docs.append(np.array(owners)[np.searchsorted(offsets, starts, "right") - 1])
            hashes.append(found)
        pending.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > SLICE:
            end = max(text.rfind(b" ", at + 1, at + SLICE), text.rfind(b"\n", at + 1, at + SLICE))
            if end <= at:
                end = min((x for x in (text.find(b" ", at + SLICE), text.find(b"\n", at + SLICE)) if x >= 0), default=len(text))
            flush()
            pending.append(text[at:end])
            owners.append(k)
            at = end
        if size + len(text) - at > SLICE:
            flush()
        pending.append(text[at:])
        owners.append(k)
        size += len(text) - at
    flush()
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and root, the least node of its component.

    Alternating large and small stars; each round is written to the shared folder. Only grouped minima and n:1 joins are
    used, so a node of very many edges isn't gathered anywhere. Rounds grow with the logarithm of the longest path.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        least = both(edges).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both(edges).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        last, edges = edges, stage(small.where("a != b").distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found._gridloom_path = edges._gridloom_path  # for discard()
            return found
        before = now


def pack_texts(texts: list[bytes]) -> bytes:
    lengths = np.array([len(texts), *map(len, texts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(lengths + b"".join(texts))


def unpack_texts(packed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int64, n, 8))])
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
