"""Second-order boosted trees for a 0/1 label, grown level by level in Spark.

The logistic loss is expanded to second order: a row has a gradient and a
curvature. Features are cut into bins at exact quantiles once. For each level
of a tree one pass adds up, in the cluster, the gradients and curvatures of
every open node by feature and bin; from these sums the split of largest gain

    G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2)

is read off for each node. A leaf answers -G / (H + l2). What reaches the
driver is bounded by nodes, features and bins, not by rows.

Gradients are rounded to multiples of 2^-20 and added up as whole numbers, so a
model does not depend on how the rows are partitioned. Several models are grown
in the same passes, each without the rows of one fold, as cross-validation asks
for. A pass is one short job over blocks of arrays that the executors keep, with
the margins of all trees so far; every few rounds they are written, so little is
done again when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantile_table
from ..functions.staging import materialize

_UNIT = float(1 << 20)
#: Rounds between two writes of the margins.
_WRITTEN = 10
#: A partition has at least so many rows, where there are as many, and at most so many.
_LEAST_ROWS, _MOST_ROWS = 1 << 15, 1 << 20
#: A split must lower the loss by more than this.
_LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    l2: float = 1.0
    least_curvature: float = 1.0
    bins: int = 64


@dataclass
class Tree:
    """A complete binary tree in arrays: children of i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node each row has reached at this depth, or the leaf it stopped at."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            feature = self.feature[at]
            right = bins[rows, np.maximum(feature, 0)] > self.bin[at]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class BoostedModel:
    """Trees over binned features; ``edges`` are each feature's bin ends, a value belongs to the first not below it."""

    edges: list[np.ndarray]
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return _binned(x, self.edges)

    def margin(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[start:]:
            out += tree.leaf[tree.nodes(bins, self.settings.depth)]
        return out

    @property
    def importances(self) -> np.ndarray:
        """Mean gain of each feature's splits, as shares."""
        total, splits = np.zeros(len(self.edges)), np.zeros(len(self.edges))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
            np.add.at(splits, tree.feature[inner], 1)
        mean = np.divide(total, splits, out=np.zeros_like(total), where=splits > 0)
        return mean / mean.sum() if mean.sum() else mean

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``positive``, the probability of label 1, from the column ``features``."""

        @F.arrow_udf(T.DoubleType())
        def positive(x: pa.Array) -> pa.Array:
            return pa.array(_sigmoid(self.margin(self.bins(_matrix(x, len(self.edges))))))

        out = df.withColumn("positive", positive(vector_to_array("features")))
        return out.withColumn("prediction", (F.col("positive") >= 0.5).cast("double"))


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each row in whole units."""
    p = _sigmoid(margin)
    return np.rint(weight * (p - y) * _UNIT), np.rint(weight * p * (1 - p) * _UNIT)


def bin_edges(train: DataFrame, bins: int) -> list[np.ndarray]:
    """Inner bin ends of every feature at its exact quantiles."""
    probs = [i / bins for i in range(1, bins)]
    values = train.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    rows = quantile_table(values, "value", probs, ["feature"]).collect()  # one row per feature
    return [np.unique([r[f"q{i}"] for i in range(len(probs))]) for r in sorted(rows, key=lambda r: r["feature"])]


def grow(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, settings: Settings) -> None:
    """Split the nodes of a level by their sums by (node, feature, bin); what a split leaves on either side answers as a leaf.

    Nodes that no row reaches have no sums and stay as they are. The children's
    answers come from the same sums, so the last level needs no pass.
    """
    g, h = g / _UNIT, h / _UNIT
    total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h

    def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * a / (b + settings.l2)

    def answer(a: float, b: float) -> float:
        return -settings.rate * a / (b + settings.l2)

    gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(total_g, total_h)[:, None, None]
    gain = np.where((left_h >= settings.least_curvature) & (right_h >= settings.least_curvature), gain, -np.inf)
    if level == 0:
        tree.leaf[0] = answer(total_g[0], total_h[0])
    for i, best in enumerate(gain.reshape(len(g), -1).argmax(axis=1)):
        j, at = divmod(int(best), gain.shape[2])
        if gain[i, j, at] > _LEAST_GAIN:
            node = 2**level - 1 + i
            tree.feature[node], tree.bin[node], tree.gain[node] = j, at, gain[i, j, at]
            tree.leaf[2 * node + 1] = answer(left_g[i, j, at], left_h[i, j, at])
            tree.leaf[2 * node + 2] = answer(right_g[i, j, at], right_h[i, j, at])


class Block(NamedTuple):
    """Rows of a partition as arrays; ``margins`` has one column per model."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    margins: np.ndarray

    def record(self) -> tuple[bytes, ...]:
        return tuple(a.tobytes() for a in self)


_BLOCKS = "bins binary, y binary, fold binary, margins binary"


def _blocks(table: DataFrame, width: int, models: int) -> RDD:
    """The rows of a written table of blocks, kept by the executors for the passes to come."""

    def block(r: Row) -> Block:
        margins = np.frombuffer(r["margins"], np.float64).reshape(-1, models)
        return Block(np.frombuffer(r["bins"], np.uint8).reshape(-1, width), np.frombuffer(r["y"], np.float64), np.frombuffer(r["fold"], np.int32), margins)

    return table.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def _level_sums(rows: RDD, settings: Settings, width: int, folds: Sequence[int], weights: Sequence[float], trees: Sequence[Tree], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by (model, node of the level, feature, bin) over all rows, in one pass."""
    shape = (len(trees), 2**level, width, settings.bins)
    first, cells = 2**level - 1, 2**level * width * settings.bins

    def add_up(blocks: Iterable[Block]) -> Iterator[np.ndarray]:
        sums = np.zeros((2, len(trees), cells), np.int64)
        for block in blocks:
            for m, tree in enumerate(trees):
                node = tree.nodes(block.bins, level) - first
                mine = np.flatnonzero((block.fold != folds[m]) & (node >= 0))
                y = block.y[mine]
                parts = gradients(block.margins[mine, m], y, np.where(y == 1, weights[m], 1.0))
                cell = ((node[mine, None] * width + np.arange(width)) * settings.bins + block.bins[mine]).ravel()
                for total, part in zip(sums, parts):
                    total[m] += np.rint(np.bincount(cell, np.repeat(part, width), cells)).astype(np.int64)
        yield sums

    g, h = rows.mapPartitions(add_up).treeReduce(np.add)
    return g.reshape(shape).astype(float), h.reshape(shape).astype(float)


def _moved(rows: RDD, trees: Sequence[Tree], depth: int) -> RDD:
    """The rows with the margins of one more tree per model."""

    def more(block: Block) -> Block:
        new = np.column_stack([t.leaf[t.nodes(block.bins, depth)] for t in trees])
        return block._replace(margins=block.margins + new)

    return rows.map(more).persist(StorageLevel.MEMORY_AND_DISK)


def _written(spark: SparkSession, rows: RDD, width: int, models: int) -> RDD:
    """The same rows from a written table, which a lost executor does not take along."""
    table = spark.createDataFrame(rows.map(Block.record), _BLOCKS, verifySchema=False)
    return _blocks(materialize(table, "margins"), width, models)


def fit_boosted(train: DataFrame, label: str, fold: str | None = None, folds: Sequence[int] = (-1,), settings: Settings = Settings()) -> list[BoostedModel]:
    """One model for each of ``folds``, grown on the rows whose ``fold`` is another; positives weigh as much as negatives in all.

    ``train`` has a vector column ``features`` without nulls and should be a
    written table. Bins are cut on all of its rows.
    """
    edges = bin_edges(train, settings.bins)
    models = [BoostedModel(edges, settings) for _ in folds]
    y = F.col(label).cast("double")
    placed = train.where(y.isNotNull()).select("features", y.alias("y"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    counts = placed.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows per fold
    weights = []
    for f in folds:
        n = [sum(r["n"] for r in counts if r["fold"] != f and r["y"] == v) for v in (0.0, 1.0)]
        weights.append(n[0] / n[1] if all(n) else 1.0)

    n = sum(r["n"] for r in counts)
    least = max(placed.sparkSession.sparkContext.defaultParallelism, -(-n // _MOST_ROWS))
    parts = max(1, min(least, -(-n // _LEAST_ROWS)))

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(_matrix(batch.column(0), len(edges)), edges)
            y, fold = (batch.column(i).to_numpy() for i in (1, 2))
            block = Block(bins, y, fold, np.zeros((len(y), len(folds))))
            yield pa.record_batch([pa.array([b], pa.binary()) for b in block.record()], names=list(Block._fields))

    dealt = placed.select(vector_to_array("features").alias("x"), "y", "fold").repartition(parts)
    rows = _blocks(materialize(dealt.mapInArrow(binned, _BLOCKS), "binned"), len(edges), len(folds))
    behind = None
    for turn in range(settings.rounds):
        trees = [Tree.empty(settings.depth) for _ in models]
        for level in range(settings.depth):
            first = 2**level - 1
            if level and not any((t.feature[(first - 1) // 2 : first] >= 0).any() for t in trees):
                break
            g, h = _level_sums(rows, settings, len(edges), folds, weights, trees, level)
            for m, tree in enumerate(trees):
                grow(tree, level, g[m], h[m], settings)
            if behind is not None:
                behind.unpersist()
                behind = None
        for model, tree in zip(models, trees):
            model.trees.append(tree)
        behind, rows = rows, _moved(rows, trees, settings.depth)
        if (turn + 1) % _WRITTEN == 0:
            moved, rows = rows, _written(placed.sparkSession, rows, len(edges), len(folds))
            moved.unpersist()
    for kept in (behind, rows):
        kept.unpersist()
    return models
