"""Gradient-boosted trees grown leaf by leaf from histograms that Spark adds up.

Features are binned once, into blocks of rows that stay with the executors. For a tree, tasks send sums of gradients and Hessians for each
(node, feature, bin); the driver sees only those totals, whose number doesn't depend on the rows, and splits the leaf of greatest
gain. A pass over the rows serves all nodes that the growth so far can need next, so a tree takes about as many passes as it is deep.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from gridloom.sources.staging import discard, stage

OBJECTIVES = ("squared", "tweedie", "logistic")
#: Bins of a feature at most: a bin is a byte.
MOST_BINS = 255
#: Up to so many values (rows times features, a byte each) are learned from in one task; the trees are the same.
MOST_LOCAL = 1 << 22
#: The rows' scores are written out after so many trees, which ends their lineage.
TREES_PER_STAGE = 50


@dataclass(frozen=True)
class Settings:
    """objective: squared, tweedie (mean by a logarithmic link, variance as mean ** power) or logistic (label 0 or 1).
    A tree has at most `leaves` leaves, each of min_rows rows and min_hessian at least. Each tree sees row_share of the rows and
    feature_share of the features, drawn by seed."""

    objective: str = "squared"
    rounds: int = 200
    leaves: int = 31
    rate: float = 0.05
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    power: float = 1.1
    row_share: float = 1.0
    feature_share: float = 1.0
    bins: int = MOST_BINS
    seed: int = 0

    def __post_init__(self) -> None:
        if self.objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.objective!r}")
        if not 2 <= self.bins <= MOST_BINS or self.leaves < 2:
            raise ValueError("at least two leaves, and 2 to 255 bins")


def gradients(objective: str, y: np.ndarray, score: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the score."""
    if objective == "squared":
        return score - y, np.ones_like(y)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-score))
        return p - y, p * (1 - p)
    a, b = np.exp((1 - power) * score), np.exp((2 - power) * score)
    return b - y * a, (2 - power) * b - y * (1 - power) * a


def start_score(objective: str, mean: float) -> float:
    """The best constant score, for labels of that mean."""
    if objective == "squared":
        return mean
    if objective == "logistic":
        p = min(max(mean, 1e-12), 1 - 1e-12)
        return math.log(p / (1 - p))
    return math.log(max(mean, 1e-12))


def response(objective: str, score: np.ndarray) -> np.ndarray:
    return score if objective == "squared" else 1 / (1 + np.exp(-score)) if objective == "logistic" else np.exp(score)


@dataclass(frozen=True)
class Split:
    """Rows of `node` with a bin of `feature` up to `bin` go to the node `left`, others to left + 1."""

    node: int
    feature: int
    bin: int
    left: int


def leaves_of(bins: np.ndarray, splits: list[Split]) -> np.ndarray:
    """The node where each column of bins (features x rows) ends up; a node's split comes after its parent's."""
    node = np.zeros(bins.shape[1], np.int32)
    for s in splits:
        there = np.flatnonzero(node == s.node)
        node[there] = s.left + (bins[s.feature, there] > s.bin)
    return node


def histogram(bins: np.ndarray, slot: np.ndarray, n_slots: int, features: list[int], g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number, gradient and Hessian by (slot, feature, bin), the last two axes dense; rows of a negative slot are left out."""
    out = np.zeros((3, n_slots, len(features), MOST_BINS + 1))
    kept = np.flatnonzero(slot >= 0)
    base, g, h = slot[kept].astype(np.int64) * (MOST_BINS + 1), g[kept], h[kept]
    for k, f in enumerate(features):
        code = base + bins[f, kept]
        for i, w in enumerate((None, g, h)):
            out[i, :, k] = np.bincount(code, w, n_slots * (MOST_BINS + 1)).reshape(n_slots, -1)
    return out


@dataclass
class Node:
    """A node's best split, gain 0 if there is none, with the rows, gradients and Hessians (n, g, h) of itself and of both sides."""

    total: tuple[float, float, float]
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    sides: tuple[tuple[float, float, float], ...] = ()
    left: int | None = None


def best_split(hist: np.ndarray, features: list[int], s: Settings) -> Node:
    """From a node's histogram (3, features, bins). Of equal gains the first feature's first bin, within rounding."""
    n, g, h = hist[:, 0].sum(1)
    node = Node((float(n), float(g), float(h)))
    left = np.cumsum(hist, 2)[:, :, :-1]
    right = np.array([n, g, h])[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / (left[2] + s.l2) + right[1] ** 2 / (right[2] + s.l2) - g * g / (h + s.l2)
    ok = (left[0] >= s.min_rows) & (right[0] >= s.min_rows) & (left[2] >= s.min_hessian) & (right[2] >= s.min_hessian) & np.isfinite(gain)
    gain = np.where(ok, gain, 0.0)
    top = float(gain.max(initial=0.0))
    if top > 1e-12 * max(1.0, abs(g)):
        k, b = np.argwhere(gain >= top * (1 - 1e-9))[0]
        node.gain, node.feature, node.bin = top, features[int(k)], int(b)
        node.sides = tuple(tuple(x[:, k, b].tolist()) for x in (left, right))
    return node


class Growth:
    """One tree while it grows. Nodes are numbered as they are needed; splits are made in the order of their gains, as long as the
    children of those already made are known."""

    def __init__(self, settings: Settings, features: list[int]):
        self.settings, self.features = settings, features
        self.nodes: dict[int, Node] = {}
        self.histograms: dict[int, np.ndarray] = {}
        self.parents: dict[int, int] = {}
        self.used = 1

    def order(self) -> list[int]:
        """The nodes that would be split, by what is known now."""
        if 0 not in self.nodes:
            return []
        queue, out = [(-self.nodes[0].gain, 0)], []
        while queue and len(out) < self.settings.leaves - 1:
            gain, k = heapq.heappop(queue)
            if not gain:
                break
            out.append(k)
            left = self.nodes[k].left
            for child in (left, left + 1) if left is not None else ():
                if child in self.nodes:
                    heapq.heappush(queue, (-self.nodes[child].gain, child))
        return out

    def number(self, k: int) -> int:
        """The number of the left child of a node, which gets one if it has none."""
        node = self.nodes[k]
        if node.left is None:
            node.left, self.used = self.used, self.used + 2
            self.parents |= {node.left: k, node.left + 1: k}
        return node.left

    def wanted(self) -> list[int]:
        """Nodes whose histograms the next step needs; none when the tree is done. The last split's children never are, and of two
        children the larger one's is what the smaller one's leaves of their parent's."""
        if 0 not in self.nodes:
            return [0]
        order, out = self.order(), []
        for k in order if len(order) < self.settings.leaves - 1 else order[:-1]:
            left = self.number(k)
            if left not in self.nodes:
                out.append(left + (self.nodes[k].sides[1][0] < self.nodes[k].sides[0][0]))
        return out

    def learn(self, numbers: list[int], hist: np.ndarray) -> None:
        for i, k in enumerate(numbers):
            found = {k: hist[:, i]}
            if k:
                parent = self.parents[k]
                left = self.nodes[parent].left
                found[2 * left + 1 - k] = self.histograms.pop(parent) - hist[:, i]
            for node, h in found.items():
                self.nodes[node], self.histograms[node] = best_split(h, self.features, self.settings), h

    def known_splits(self) -> list[Split]:
        """All splits with numbered children, parents first."""
        out, queue = [], [0]
        while queue:
            k = queue.pop()
            node = self.nodes.get(k)
            if node is not None and node.left is not None:
                out.append(Split(k, node.feature, node.bin, node.left))
                queue += [node.left, node.left + 1]
        return out

    def tree(self) -> Tree:
        """The finished tree: its splits and each leaf's value."""
        splits, totals = [], {0: self.nodes[0].total}
        for k in self.order():
            node, left = self.nodes[k], self.number(k)
            splits.append(Split(k, node.feature, node.bin, left))
            totals.pop(k)
            totals[left], totals[left + 1] = node.sides
        s = self.settings
        return Tree(splits, {k: -s.rate * g / (h + s.l2) if h + s.l2 > 0 else 0.0 for k, (_, g, h) in totals.items()})


@dataclass
class Tree:
    splits: list[Split]
    values: dict[int, float]

    def plain(self) -> dict:
        return {"splits": [[s.node, s.feature, s.bin, s.left] for s in self.splits], "values": {str(k): v for k, v in self.values.items()}}

    @classmethod
    def of(cls, plain: dict) -> Tree:
        return cls([Split(*s) for s in plain["splits"]], {int(k): v for k, v in plain["values"].items()})

    def scores(self, bins: np.ndarray) -> np.ndarray:
        table = np.zeros(max(self.values) + 1)
        for k, v in self.values.items():
            table[k] = v
        return table[leaves_of(bins, self.splits)]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows) of values (features x rows): how many edges lie below."""
    return np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, values, strict=True)]).astype(np.uint8) if edges else np.zeros((0, 0), np.uint8)


@dataclass
class Model:
    """A fitted ensemble; edges are the bins' upper bounds for each feature."""

    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    settings: Settings

    def predict(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """rows with a further column, the mean or probability for each. Features that are null or not a number count as -1."""
        shared = rows.sparkSession.sparkContext.broadcast(self)  # rounds * leaves numbers
        kept = rows.drop(name)
        inputs = [f"gridloom_{k}" for k in range(len(self.features))]
        schema = StructType([*kept.schema.fields]).add(name, DoubleType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                bins = binned(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]), model.edges)
                score = np.full(batch.num_rows, model.start)
                for tree in model.trees:
                    score += tree.scores(bins)
                names = [c for c in batch.schema.names if c not in inputs]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(response(model.settings.objective, score))], names=[*names, name])

        return kept.select("*", *(number(c).alias(i) for c, i in zip(self.features, inputs, strict=True))).mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """As one line of JSON, in any store that Spark writes; what was there is replaced."""
        trees = [t.plain() for t in self.trees]
        text = json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "start": self.start, "settings": asdict(self.settings), "trees": trees})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        found = json.loads(spark.read.text(path).first()[0])
        return cls(found["features"], [np.array(e) for e in found["edges"]], found["start"], [Tree.of(t) for t in found["trees"]], Settings(**found["settings"]))


def number(column: str) -> Column:
    """A feature as a double; null and not a number are -1."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(-1.0)), F.lit(-1.0))


def bin_edges(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of each column's bins but the last: between all values if there are at most `bins`, else quantiles to one part in
    ten thousand. The driver sees some `bins` numbers a column."""
    asked = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    rough = rows.agg(*(F.approx_count_distinct(c).alias(c) for c in columns), *(F.percentile_approx(c, asked, 10_000).alias(f"{c}_q") for c in columns), *(F.max(c).alias(f"{c}_top") for c in columns)).first()
    few = [c for c in columns if rough[c] <= 1.2 * bins]  # the estimate is within a twentieth
    known = rows.agg(*(F.collect_set(c).alias(c) for c in few)).first() if few else {}
    out = []
    for c in columns:
        values = np.array(sorted(known[c])) if c in few else None
        if values is not None and len(values) <= bins:
            out.append((values[:-1] + values[1:]) / 2)
        else:
            out.append(np.array([v for v in sorted(set(rough[f"{c}_q"] or [])) if v < rough[f"{c}_top"]]))
    return out


def _drawn(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Which rows a tree sees: by a scrambled 64-bit key, the same wherever the row is."""
    x = key ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1342543DE82EF95) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


def tree_features(settings: Settings, n: int, tree: int) -> list[int]:
    """The features that a tree may split on."""
    kept = max(1, math.ceil(settings.feature_share * n - 1e-9))
    return sorted(np.random.default_rng([settings.seed, tree]).permutation(n)[:kept].tolist())


PARTS = ("bins", "y", "key", "score")
BLOCKS = "n int, bins binary, y binary, key binary, score binary"


def _block(row: dict) -> tuple[np.ndarray, ...]:
    y, key, score = (np.frombuffer(row[c], t) for c, t in (("y", np.float64), ("key", np.uint64), ("score", np.float64)))
    return np.frombuffer(row["bins"], np.uint8).reshape(-1, row["n"]), y, key, score


def _grown(settings: Settings, n_features: int, sums: Callable[[Growth, list[int], int], np.ndarray], add: Callable[[Tree, int], None]) -> list[Tree]:
    """All trees, given the sums over rows for nodes of a tree, and what is to be done with a finished one."""
    trees = []
    for t in range(settings.rounds):
        growth = Growth(settings, tree_features(settings, n_features, t))
        while wanted := growth.wanted():
            growth.learn(wanted, sums(growth, wanted, t))
        tree = growth.tree()
        if not tree.splits:
            if settings.row_share == settings.feature_share == 1:
                break  # nor would a later tree have one
            continue
        trees.append(tree)
        add(tree, t)
    return trees


def _slots(growth: Growth, wanted: list[int], bins: np.ndarray) -> np.ndarray:
    """Which of the wanted nodes each row is in, or -1."""
    slots = np.full(growth.used, -1)
    slots[wanted] = np.arange(len(wanted))
    return slots[leaves_of(bins, growth.known_splits())]


def _local(blocks: DataFrame, settings: Settings, n_features: int) -> list[Tree]:
    """The trees, learned in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_block(row) for batch in batches for row in batch.to_pylist()]
        bins = np.concatenate([p[0] for p in parts], 1)
        y, key, score = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        at: dict = {}

        def sums(growth: Growth, wanted: list[int], tree: int) -> np.ndarray:
            if at.get("tree") != tree:
                seen = _drawn(key, settings.row_share, settings.seed, tree) if settings.row_share < 1 else np.ones(len(y), bool)
                at.update(tree=tree, bins=bins[:, seen], g=gradients(settings.objective, y[seen], score[seen], settings.power))
            return histogram(at["bins"], _slots(growth, wanted, at["bins"]), len(wanted), growth.features, *at["g"])

        def add(tree: Tree, _: int) -> None:
            score[:] += tree.scores(bins)

        found = [tree.plain() for tree in _grown(settings, n_features, sums, add)]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found)])], names=["trees"])

    return [Tree.of(t) for t in json.loads(blocks.coalesce(1).mapInArrow(run, "trees string").first()[0])]


def _sums(state: DataFrame, growth: Growth, wanted: list[int], tree: int) -> np.ndarray:
    """The histogram of the wanted nodes over all rows that the tree sees."""
    settings, features = growth.settings, growth.features
    shape = (len(wanted), len(features), MOST_BINS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, *shape))
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, key, score = _block(row)
                slot = _slots(growth, wanted, bins)
                if settings.row_share < 1:
                    slot = np.where(_drawn(key, settings.row_share, settings.seed, tree), slot, -1)
                total += histogram(bins, slot, len(wanted), features, *gradients(settings.objective, y, score, settings.power))
        flat = total.reshape(3, -1)
        code = np.flatnonzero(flat[0])
        yield pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(x[code]) for x in flat)], names=["code", "n", "g", "h"])

    found = state.mapInArrow(run, "code long, n double, g double, h double").groupBy("code").agg(*(F.sum(c).alias(c) for c in "ngh")).toArrow()
    out = np.zeros((3, math.prod(shape)))
    out[:, found.column("code").to_numpy()] = [found.column(c).to_numpy() for c in "ngh"]
    return out.reshape(3, *shape)


def _scored(state: DataFrame, tree: Tree) -> DataFrame:
    """The blocks with the tree's values added to the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for row in batch.select(["n", *PARTS]).to_pylist():
                bins, _, _, score = _block(row)
                scores.append((score + tree.scores(bins)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.binary())], names=batch.schema.names)

    return state.mapInArrow(run, BLOCKS)


def fit(rows: DataFrame, features: list[str], label: str, settings: Settings = Settings()) -> Model:
    """An ensemble from rows with the given features and label (null labels are left out; for tweedie they must not be negative).

    Rows that are equal are drawn alike. Without rows, or where no split is allowed, the model is a constant."""
    spark = rows.sparkSession
    inputs = [f"x{k}" for k in range(len(features))]
    plain = rows.where(F.col(label).isNotNull()).select(*(number(c).alias(i) for c, i in zip(features, inputs, strict=True)), F.col(label).cast("double").alias("y"))
    plain = plain.withColumn("key", F.xxhash64(*inputs, "y"))
    edges = bin_edges(plain, inputs, settings.bins)
    n, mean = plain.agg(F.count("*"), F.avg("y")).first()
    if not n:
        return Model(features, edges, 0.0, [], settings)
    start = start_score(settings.objective, float(mean))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = binned(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]), edges)
            y, key = batch.column("y").to_numpy(zero_copy_only=False), batch.column("key").to_numpy().view(np.uint64)
            parts = [bins, y, key, np.full(len(y), start)]
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["n", *PARTS])

    blocks = stage(plain.mapInArrow(block, BLOCKS), "boosting-blocks")
    if n * len(features) <= MOST_LOCAL:
        trees = _local(blocks, settings, len(features))
        discard(blocks)
        return Model(features, edges, start, trees, settings)
    staged, kept = [blocks], [blocks.persist(StorageLevel.MEMORY_AND_DISK)]

    def sums(growth: Growth, wanted: list[int], tree: int) -> np.ndarray:
        out = _sums(kept[-1], growth, wanted, tree)
        while len(kept) > 1:  # the scores have been computed from it
            kept.pop(0).unpersist()
        return out

    def add(tree: Tree, t: int) -> None:
        state = _scored(kept[-1], tree)
        if (t + 1) % TREES_PER_STAGE == 0 and t + 1 < settings.rounds:
            state = stage(state, "boosting-blocks")
            staged.append(state)
        kept.append(state.persist(StorageLevel.MEMORY_AND_DISK))

    trees = _grown(settings, len(features), sums, add)
    for df in kept:
        df.unpersist()
    discard(*staged)
    return Model(features, edges, start, trees, settings)
