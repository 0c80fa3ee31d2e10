"""Toxicity by logistic regression on hashed word n-grams and skip-grams, trained with FTRL-proximal.

Per-coordinate rates and an L1 term leave few weights other than zero, so the model is small enough to broadcast: its
size is bounded by the number of hash buckets, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from gridloom.llm.common import NOT_ALNUM, joined, mix, release, word_hashes


@dataclass(frozen=True)
class Settings:
    """Hash buckets are 2**bits. The training sample has at most `positives` and `negatives` rows of each label, those
    whose hashed doc_id is least."""

    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 6
    positives: int = 4000
    negatives: int = 12000


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash bucket of every feature of a batch: words, pairs of neighbours, and pairs with one word
    between. Words are lower-cased runs of letters, digits and non-ASCII characters."""
    buffer, offsets = joined(texts)
    starts, _, words = word_hashes(buffer, NOT_ALNUM)
    doc = np.searchsorted(offsets, starts, "right") - 1
    docs, hashes = [doc], [words]
    for gap, salt in ((1, np.uint64(0x51ED270B)), (2, np.uint64(0xC2B2AE35))):
        same = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
        docs.append(doc[: len(same)][same])
        hashes.append(mix(words[: len(same)][same] * np.uint64(31) + words[gap : gap + len(same)][same] + salt))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: list[np.ndarray], labels: list[int], settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets and weights other than zero, and the bias. rows: each text's distinct buckets."""
    z, n = np.zeros(1 << settings.bits), np.zeros(1 << settings.bits)
    bias_z = bias_n = 0.0
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2
    order = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for k in order.permutation(len(rows)):
            x = rows[k]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > l1, (np.sign(zx) * l1 - zx) / ((b + root) / a + l2), 0.0)
            bias = -bias_z / ((b + bias_n**0.5) / a + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / a * w
            n[x] = nx + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / a * bias
            bias_n += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((b + np.sqrt(n)) / a + l2), 0.0)
    kept = np.flatnonzero(w)
    return kept, w[kept], -bias_z / ((b + bias_n**0.5) / a + l2)


@dataclass
class Model:
    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """From 0 to 1 for each text; a feature that repeats within a text counts once."""
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.buckets] = self.weights
        docs, buckets = features(texts, self.bits)
        used = np.flatnonzero(dense[buckets])
        pairs = np.unique((docs[used] << self.bits) | buckets[used])
        total = np.bincount(pairs >> self.bits, weights=dense[pairs & ((1 << self.bits) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from texts (doc_id, text) and labels (doc_id, label 0 or 1), in one task, on the bounded sample of Settings.

    The sample is chosen among the labels alone, by hashed doc_id, so only its texts move; its ids are broadcast, at most
    `positives` + `negatives` of them. Other labels, and ids that are null or unknown, are left out; a null text is
    empty; of repeated doc_ids as many rows are used as the bounds allow. Without rows, all scores are one half.
    """
    bounds = ((1, settings.positives), (0, settings.negatives))
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    ids = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in bounds]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids[0].unionAll(ids[1])), "doc_id")
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "text").limit(most).select("label", "text") for y, most in bounds]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        labels: list[int] = []
        for batch in batches:
            labels += batch.column("label").to_pylist()
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for k in range(0, len(texts), 250):
                docs, buckets = features(texts[k : k + 250], settings.bits)
                pairs = np.unique((docs << settings.bits) | buckets)
                cuts = np.searchsorted(pairs >> settings.bits, np.arange(1, len(texts[k : k + 250])))
                found += [p.astype(np.int32) for p in np.split(pairs & ((1 << settings.bits) - 1), cuts)]
        buckets, weights, bias = train(found, labels, settings)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(buckets, -1), pa.int64()), pa.array(np.append(weights, bias))], names=["bucket", "weight"]
        )

    learned = parts[0].unionAll(parts[1]).coalesce(1).mapInArrow(learn, "bucket long, weight double").toArrow()
    buckets, weights = learned.column("bucket").to_numpy(), learned.column("weight").to_numpy()
    real = buckets >= 0
    return Model(settings.bits, buckets[real], weights[real], float(weights[~real].sum()))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a further column: each whole text's score. A column of that name is replaced; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    schema = StructType(kept.schema.fields[:]).add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            some = lambda k: [t or b"" for t in texts[k : k + 250].to_pylist()]
            scores = np.concatenate([model.scores(some(k)) for k in range(0, len(texts), 250)] or [np.zeros(0)])
            release()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)

