"""Gradient boosting on the log target with a penalty on leaf values, for all folds at once.

The library's trees have no such penalty, so the trees are grown here. Features are cut into bins once, by
quantiles of each fold's own training rows. One pass over the binned rows per level of a tree sums
gradients and counts per (fold, node, feature, bin). The sums are added up and the splits of every fold decided
on the executors; only the splits reach the driver, a few numbers a node. A tree of depth three takes three passes.

Rows stay in blocks on the executors. A block's scores follow from its rows and the trees so far, so a lost
block is worked out again from the stored rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.schemas import CATEGORIES, feature_columns
from panelwright.session import settle

# Depth, rounds, step, penalty on leaf values, least rows of a leaf, bins.
DEPTH, ROUNDS, STEP, PENALTY, LEAST, BINS = 3, 300, 0.05, 1.0, 20, 255
#: Rows of a partition, about; rounds after which the blocks take up the new trees.
ROWS, RENEW = 50_000, 10
LOG_TARGET = "y_log"


@dataclass(frozen=True)
class Trees:
    """Trees of all folds. Nodes are numbered by level; a node without a split (-1) passes all rows to its left."""

    base: np.ndarray  # fold
    split: np.ndarray  # fold, round, node: feature
    cut: np.ndarray  # fold, round, node: largest value that goes left
    leaf: np.ndarray  # fold, round, leaf

    def predict(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Log prediction of rows, each by the trees of its fold."""
        out, rows = self.base[fold], np.arange(len(x))
        for r in range(self.split.shape[1]):
            node = np.zeros(len(x), np.int64)
            for depth in range(DEPTH):
                at = (1 << depth) - 1 + node
                f = self.split[fold, r, at]
                node = 2 * node + ((f >= 0) & (x[rows, f] > self.cut[fold, r, at]))
            out = out + self.leaf[fold, r, node]
        return out


# Some rows, as plain values that tasks need no package for: bins (fold, row, feature), target, which rows
# train a fold (fold, row), and scores (fold, row).
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def node_of(bins: np.ndarray, split: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Node of each (fold, row) at a depth of the trees ``split, cut`` (fold, node), counted within the level."""
    folds, rows = np.ogrid[: bins.shape[0], : bins.shape[1]]
    node = np.zeros(bins.shape[:2], np.int64)
    for d in range(depth):
        at = (1 << d) - 1 + node
        f = split[folds, at]
        node = 2 * node + ((f >= 0) & (bins[folds, rows, f] > cut[folds, at]))
    return node


def with_trees(block: Block, trees: Sequence[tuple]) -> Block:
    """The block after some more trees."""
    bins, y, trains, score = block
    folds = np.arange(len(score))[:, None]
    for split, cut, leaf in trees:
        score = score + leaf[folds, node_of(bins, split, cut, DEPTH)]
    return bins, y, trains, score


def level_sums(block: Block, split: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Residuals and counts of training rows per (fold, node of the level, feature, bin)."""
    bins, y, trains, score = block
    n_folds, _, n_features = bins.shape
    place = np.arange(n_folds)[:, None] * (1 << depth) + node_of(bins, split, cut, depth)
    fold, row = np.nonzero(trains)
    at = ((place[fold, row][:, None] * n_features + np.arange(n_features)) * BINS + bins[fold, row]).ravel()
    rest = np.repeat((y - score)[fold, row], n_features)
    shape = (n_folds, 1 << depth, n_features, BINS)
    size = int(np.prod(shape))
    return np.stack([np.bincount(at, rest, size).reshape(shape), np.bincount(at, minlength=size).reshape(shape)])


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and bin of the best split of every node, and (residuals, counts) of its two sides."""
    left = np.cumsum(sums, axis=-1)[..., :-1]
    total = sums[:, :, :, 0].sum(axis=-1)  # every feature sees all rows
    right = total[..., None, None] - left
    (gl, nl), (gr, nr), (g, n) = left, right, total
    gain = gl**2 / (nl + PENALTY) + gr**2 / (nr + PENALTY) - (g**2 / (n + PENALTY))[..., None, None]
    gain = np.where((nl >= LEAST) & (nr >= LEAST), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=-1)
    found = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 0
    feature, cut = np.divmod(best, gain.shape[-1])
    folds, nodes = np.ogrid[: gain.shape[0], : gain.shape[1]]
    one = np.where(found, left[:, folds, nodes, feature, cut], total)
    return np.where(found, feature, -1), cut, np.stack([one, total - one], axis=-1)


def quantile_bins(df: DataFrame, features: Sequence[str], before: Sequence[int | None]) -> tuple[list, np.ndarray, np.ndarray]:
    """Cut points of every (fold, feature), mean target and rows of every fold, from one aggregate.

    A fold's training rows are those before its quarter (None: all). Ranks of cut points are
    exact up to 10,000 rows and off by less than a 10,000th of them beyond.
    """
    folds = F.filter(
        F.array(*[F.lit(k) if p is None else F.when(F.col("period_ord") < p, k) for k, p in enumerate(before)]),
        lambda k: k.isNotNull(),
    )
    shares = ", ".join(f"{i / BINS}D" for i in range(1, BINS))
    found = df.select("*", F.explode(folds).alias("_fold")).groupBy("_fold").agg(
        F.count("*").alias("_n"), F.avg(LOG_TARGET).alias("_mean"),
        *[F.expr(f"percentile_approx(`{f}`, array({shares}), 10000)").alias(f) for f in features],
    ).collect()  # one row a fold
    by_fold = {r["_fold"]: r for r in found}
    if len(by_fold) < len(before):
        raise ValueError("no training rows")
    cuts = [[np.unique(by_fold[k][f]) for f in features] for k in range(len(before))]
    return cuts, *(np.array([by_fold[k][c] for k in range(len(before))], float) for c in ("_mean", "_n"))


def _blocks(df: DataFrame, features: Sequence[str], before: Sequence[int | None], cuts: list, base: np.ndarray, parts: int) -> RDD:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(len(features))])
            bins = np.stack([np.stack([np.searchsorted(c, v) for c, v in zip(own, x)], axis=-1) for own in cuts])
            quarter = batch.column(len(features) + 1).to_numpy()
            trains = np.stack([quarter < p if p is not None else np.ones(len(quarter), bool) for p in before])
            held = (bins.astype(np.uint8).tobytes(), batch.column(len(features)).to_numpy().tobytes(), trains.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in held], names=["bins", "y", "trains"])

    stored = settle(df.select(*features, LOG_TARGET, "period_ord").coalesce(parts).mapInArrow(
        work, "bins binary, y binary, trains binary"))

    def block(row) -> Block:
        y = np.frombuffer(row.y)
        trains = np.frombuffer(row.trains, bool).reshape(len(before), len(y))
        bins = np.frombuffer(row.bins, np.uint8).reshape(len(before), len(y), len(features))
        return bins, y, trains, np.repeat(base[:, None], len(y), axis=1)

    return stored.rdd.map(block)


def _renewed(blocks: RDD, trees: tuple) -> RDD:
    return blocks.map(lambda b: with_trees(b, trees)).persist(StorageLevel.MEMORY_AND_DISK)


def _level(blocks: RDD, trees: tuple, split: np.ndarray, cut: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best splits of a level over all rows, see ``best_splits``."""
    def own(part: Iterator[Block]) -> list[np.ndarray]:
        total = None
        for block in part:
            sums = level_sums(with_trees(block, trees), split, cut, depth)
            total = sums if total is None else total + sums
        return [] if total is None else [total]

    sums = blocks.mapPartitions(own)
    if blocks.getNumPartitions() == 1:
        return sums.map(best_splits).first()
    folds, nodes = len(split), 1 << depth
    parts = sums.flatMap(lambda s: [((f, k), s[:, f : f + 1, k : k + 1]) for f in range(folds) for k in range(nodes)])
    found = dict(parts.reduceByKey(np.add, min(folds * nodes, blocks.getNumPartitions())).mapValues(best_splits).collect())
    feature, at, sides = (
        np.concatenate([np.concatenate([found[f, k][i] for k in range(nodes)], axis=fold + 1) for f in range(folds)], axis=fold)
        for i, fold in enumerate((0, 0, 1))  # the axis of folds in each of the three
    )
    return feature, at, sides


def fit_folds(df: DataFrame, features: Sequence[str], before: Sequence[int | None], rounds: int = ROUNDS) -> Trees:
    """Trees of one fold for each quarter of ``before``, trained on the rows before it (None: on all rows)."""
    cuts, base, counts = quantile_bins(df, features, before)
    folds, inner, leaves = len(before), (1 << DEPTH) - 1, 1 << DEPTH
    blocks = _blocks(df, features, before, cuts, base, max(1, -(-int(counts.max()) // ROWS)))
    held, fresh, trees = [blocks.persist(StorageLevel.MEMORY_AND_DISK)], [], []
    for _ in range(rounds):
        if len(fresh) == RENEW:
            held.append(_renewed(held[-1], tuple(fresh)))
            fresh = []
        split, cut = np.full((folds, inner), -1), np.zeros((folds, inner), np.int64)
        for depth in range(DEPTH):
            own = slice((1 << depth) - 1, (2 << depth) - 1)
            split[:, own], cut[:, own], sides = _level(held[-1], tuple(fresh), split, cut, depth)
        for older in held[:-1]:
            older.unpersist()
        del held[:-1]
        leaf = (STEP * sides[0] / (sides[1] + PENALTY)).reshape(folds, leaves)
        trees.append((split, cut, leaf))
        fresh.append(trees[-1])
    held[-1].unpersist()
    split, cut, leaf = (np.stack(x, axis=1) for x in zip(*trees)) if trees else (
        np.zeros((folds, 0, inner), np.int64), np.zeros((folds, 0, inner), np.int64), np.zeros((folds, 0, leaves)))
    value = np.zeros(cut.shape)
    for k, r, node in np.argwhere(split >= 0):
        own = cuts[k][split[k, r, node]]
        value[k, r, node] = own[cut[k, r, node]] if cut[k, r, node] < len(own) else np.inf
    return Trees(base, split, value, leaf)


class Boosting:
    """Forecaster with the ``name`` / ``fit`` / ``predict`` protocol of the backtest; serves all folds in one fit."""

    name = "gbm"

    def __init__(self, categories: Sequence[str] = CATEGORIES, rounds: int = ROUNDS):
        self.features, self.rounds, self.model = feature_columns(categories), rounds, None

    def fit(self, train: DataFrame) -> "Boosting":
        self.model = fit_folds(train, self.features, [None], self.rounds)
        return self

    def predict(self, test: DataFrame) -> DataFrame:
        return self._scored(test, self.model, [])

    def predict_folds(self, df: DataFrame, periods: Sequence[int]) -> DataFrame:
        """Predictions of every fold's quarter, each from the quarters before it."""
        folds = sorted(periods)
        return self._scored(df.filter(F.col("period_ord").isin(folds)), fit_folds(df, self.features, folds, self.rounds), folds)

    def _scored(self, df: DataFrame, model: Trees, folds: list[int]) -> DataFrame:
        # plain values of 22 numbers a tree and fold
        shared = df.sparkSession.sparkContext.broadcast((model.base, model.split, model.cut, model.leaf))
        at = [df.columns.index(f) for f in self.features]
        when = df.columns.index("period_ord")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1)
                fold = np.zeros(len(x), np.int64)
                if folds:
                    fold = np.searchsorted(folds, batch.column(when).to_numpy())
                y = np.expm1(Trees(*shared.value).predict(x, fold))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y)], names=[*batch.schema.names, "y_pred"])

        return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField("y_pred", T.DoubleType())]))
