"""Boosted trees and class forests grown on binned rows; what is grown are Spark ML's own models.

Growing with Spark ML's trainers, every fit assembles a vector and an object of a few hundred bytes for each row, and every
level of every tree adds up all rows of all nodes.  Here a feature of a row is one byte, the number of its bin, so that six fits
share one small table of rows.  A fit deals it into blocks of arrays; a level of a tree is one pass over the blocks that adds up
histograms in numpy, and of two sisters in a boosted tree only the smaller one is added up.

The rules are those of Spark ML: at most 32 bins a feature, cut midway between values; the gain of variance or Gini; splits
without gain are none; boosting by squared error; bootstrap weights and a drawn set of features for each node of a forest; leaves of the
same class grow together.  Cuts are taken from all rows instead of a sample.  A feature that is NaN, or a label that is no number, is an error.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = "_bins"
MOST_BINS = 32
SUMMARY = 1024
"""Values kept of a feature that has more, each standing for an equal share of a task's rows."""
COLLECTED = 64
"""Partial sums of up to so many tasks are added up on the driver."""
PACKED, PIECE = 1 << 16, 32_000


# bins -------------------------------------------------------------------------------


def _condensed(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal values together; of more than ``SUMMARY``, those at equally spaced ranks.  Without ``weights`` each counts as one."""
    if weights is None:
        values, weights = np.unique(values, return_counts=True)
        weights = weights.astype(float)
    else:
        values, inverse = np.unique(values, return_inverse=True)
        weights = np.bincount(inverse, weights=weights, minlength=len(values))
    if len(values) <= SUMMARY:
        return values, weights
    ends = np.cumsum(weights)
    at = np.searchsorted(ends, (np.arange(SUMMARY) + 0.5) / SUMMARY * ends[-1])
    chosen, times = np.unique(at, return_counts=True)
    return values[chosen], times * (ends[-1] / SUMMARY)


def _cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` thresholds, midway between values; each bin but the last ends at one."""
    middles = (values[:-1] + values[1:]) / 2
    middles = np.where(np.isfinite(middles), middles, values[:-1])  # beside an infinite value
    if len(middles) < bins:
        return middles
    ends = np.cumsum(weights)[:-1]
    wanted = np.arange(1, bins) * (weights.sum() / bins)
    after = np.clip(np.searchsorted(ends, wanted), 0, len(ends) - 1)
    before = np.maximum(after - 1, 0)
    nearer = np.where(np.abs(ends[before] - wanted) < np.abs(ends[after] - wanted), before, after)
    return middles[np.unique(nearer)]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def thresholds(rows: DataFrame, columns: list[str], bins: int = MOST_BINS) -> list[np.ndarray]:
    """Of each of the double ``columns`` the cuts between its bins, from all ``rows``."""
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), np.empty(0))] * len(columns)
        for batch in batches:
            for j, column in enumerate(batch.columns):
                new = _numbers(column)
                if np.isnan(new).any():
                    raise ValueError(f"{columns[j]} is not a number in some rows")
                values, weights = _condensed(new)
                held[j] = _condensed(np.concatenate([held[j][0], values]), np.concatenate([held[j][1], weights]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["held"])

    parts = rows.select(*columns).mapInArrow(summaries, "held binary").rdd.map(lambda row: pickle.loads(row[0]))
    every = _added(parts, lambda a, b: [_condensed(np.concatenate([x, y]), np.concatenate([v, w])) for (x, v), (y, w) in zip(a, b, strict=True)])
    return [_cuts(values, weights, bins) if len(values) else values for values, weights in every or [(np.empty(0), np.empty(0))] * len(columns)]


def binned(rows: DataFrame, columns: list[str], cuts: list[np.ndarray], kept: list[str]) -> DataFrame:
    """The ``kept`` columns, and in ``BINS`` a byte for each of the double ``columns``: how many cuts lie below its value."""
    schema = rows.select(*kept).withColumn(BINS, F.lit(b"")).schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.empty((batch.num_rows, len(columns)), dtype=np.uint8)
            for j, cut in enumerate(cuts):
                codes[:, j] = np.searchsorted(cut, _numbers(batch.column(len(kept) + j)))
            ends = np.arange(0, codes.size + 1, len(columns), dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], packed], [*kept, BINS])

    return rows.select(*kept, *columns).mapInArrow(coded, schema)


def _blocks(rows: DataFrame, label: str, features: int) -> RDD:
    """Arrays of many rows each: bins (a row of the array for each feature) and labels."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, told = batch.columns
            ends = np.frombuffer(codes.buffers()[1], np.int64 if pa.types.is_large_binary(codes.type) else np.int32)
            bins = np.frombuffer(codes.buffers()[2], np.uint8)[ends[codes.offset]:ends[codes.offset + len(codes)]].reshape(len(codes), features)
            labels = _numbers(told)
            if not np.isfinite(labels).all():
                raise ValueError(f"{label} is not a number in some rows")
            block = pickle.dumps((np.ascontiguousarray(bins.T), labels), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    told = rows.select(BINS, F.col(label).cast("double").alias("_told"))
    return told.mapInArrow(packed, "block binary").rdd.map(lambda row: pickle.loads(row[0]))


def _added(parts: RDD, together: Callable[[list, list], list]) -> list:
    """What the tasks found, put together in pairs; nothing where no task found anything."""
    if parts.getNumPartitions() > COLLECTED:
        parts = parts.coalesce(math.isqrt(parts.getNumPartitions()) + 1, shuffle=True).mapPartitions(
            lambda part: [found] if (found := reduce(lambda a, b: together(a, b) if a else b, part, [])) else [])
    return reduce(together, found) if (found := parts.collect()) else []


def _sum(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


# growing ----------------------------------------------------------------------------


class _Grown:
    """A tree as a heap: the children of node ``n`` are ``2n`` and ``2n + 1``, the root is 1.

    Rows go left below and at ``cut``; below a leaf all go left, so that routing needs no exceptions.
    """

    def __init__(self, depth: int):
        size = 2 << depth
        self.feature, self.cut = np.zeros(size, dtype=np.int64), np.full(size, 255, dtype=np.uint8)
        self.splits, self.gain, self.totals = np.zeros(size, dtype=bool), np.zeros(size), {}

    def route(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row ``levels`` below the root."""
        rows, flat = bins.shape[1], bins.reshape(-1)
        node, here = np.ones(rows, dtype=np.int64), np.arange(rows)
        for _ in range(levels):
            node = 2 * node + (flat[self.feature[node] * rows + here] > self.cut[node])
        return node

    def open_nodes(self, level: int) -> list[int]:
        """Nodes of a level that come from splits."""
        return [1] if level == 0 else [n for n in range(1 << level, 2 << level) if self.splits[n >> 1]]

    def split(self, node: int, feature: int, cut: int, gain: float) -> None:
        self.feature[node], self.cut[node], self.splits[node], self.gain[node] = feature, cut, True, gain


def _best(sums: np.ndarray, score: Callable[[np.ndarray], np.ndarray], count: Callable[[np.ndarray], np.ndarray]) -> tuple[int, int, float]:
    """(feature, cut, gain) of the best split of one node from its sums by feature and bin; gain 0 if there is none."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    every = sums.sum(axis=1, keepdims=True)
    right = every - left
    possible = (count(left) > 0.5) & (count(right) > 0.5)
    gains = np.where(possible, score(left) + score(right) - score(every), 0.0) / np.maximum(count(every), 1)
    at = int(np.argmax(gains))
    feature, cut = divmod(at, gains.shape[1])
    return feature, cut, float(gains[feature, cut])


def _square(s: np.ndarray) -> np.ndarray:
    return s[..., 1] ** 2 / np.maximum(s[..., 0], 1)


def _squares(s: np.ndarray) -> np.ndarray:
    return (s**2).sum(axis=-1) / np.maximum(s.sum(axis=-1), 1)


def _sums(bins: np.ndarray, slots: np.ndarray, count: int, told: np.ndarray) -> np.ndarray:
    """Rows and sums of ``told`` by slot, feature and bin.

    Both come from one addition: a row adds its value, as a whole number, times ``PACKED``, and one.  Of up to ``PIECE`` rows such
    sums are exact; the values are exact to a part in four million of the greatest.
    """
    found = np.zeros((len(bins), count * MOST_BINS, 2))
    for begin in range(0, len(told), PIECE):
        piece = slice(begin, begin + PIECE)
        scale = np.abs(told[piece]).max() / (1 << 22) or 1.0
        packed, base = np.rint(told[piece] / scale) * PACKED + 1, slots[piece] * MOST_BINS
        sums = np.stack([np.bincount(base + codes, weights=packed, minlength=count * MOST_BINS) for codes in bins[:, piece]])
        whole = np.floor(sums / PACKED)
        found[..., 0] += sums - whole * PACKED
        found[..., 1] += whole * scale
    return found.reshape(len(bins), count, MOST_BINS, 2).swapaxes(0, 1)


def _regression_tree(blocks: RDD, depth: int, begun: Callable[[], None]) -> _Grown:
    """One tree over the second array of the blocks; every level is one pass, and after the first one all blocks are kept."""
    tree, known = _Grown(depth), {}
    for level in range(depth + 1):
        nodes = tree.open_nodes(level)
        if not nodes:
            break
        # of two sisters only the one of fewer rows is added up; on the last level only totals are needed
        wanted = nodes if level == 0 else [] if level == depth else [
            2 * p if tree.totals[p][3] <= tree.totals[p][0] / 2 else 2 * p + 1 for p in range(1 << level - 1, 1 << level) if tree.splits[p]]
        slot_of = np.full(2 << level, -1)
        slot_of[wanted] = np.arange(len(wanted))

        def partial(part: Iterator[tuple]) -> Iterator[list]:
            total, found = np.zeros((2 << level, 3)), None
            for bins, told in part:
                at = tree.route(bins, level)
                total += np.stack([np.bincount(at, weights=w, minlength=2 << level) for w in (None, told, told * told)], axis=1)
                if not wanted:
                    found = found or 0.0
                    continue
                if level:
                    at = slot_of[at]
                    rows = np.flatnonzero(at >= 0)
                    bins, told, at = np.take(bins, rows, axis=1), told[rows], at[rows]
                else:
                    at = at - 1
                new = _sums(bins, at, len(wanted), told)
                found = new if found is None else found + new
            if found is not None:
                yield [total, found]

        added = _added(blocks.mapPartitions(partial), _sum)
        if not added:
            raise ValueError("there are no rows to fit on")
        total, found = added
        if level == 0:
            begun()
        for n in nodes:
            tree.totals[n] = [*total[n], 0.0]  # rows, sum, sum of squares, rows that go left
        if level == depth:
            break
        sums = dict(zip(wanted, found, strict=True))
        for n in nodes:
            if n not in sums:
                sums[n] = known[n >> 1] - sums[n ^ 1]
        known = sums
        for n in nodes:
            rows, told, squares, _ = tree.totals[n]
            feature, cut, gain = _best(sums[n], _square, lambda s: s[..., 0])
            # what is left of equal labels is rounding
            if gain > 1e-12 * max(squares / rows, 1e-300) and squares - told**2 / rows > 0:
                tree.split(n, feature, cut, gain)
                tree.totals[n][3] = sums[n][feature, :cut + 1, 0].sum()
    return tree


def _spread_values(tree: _Grown, depth: int, value: Callable[[int], float]) -> np.ndarray:
    """Value of the leaf above or at each node of the last level."""
    values = np.zeros(2 << depth)
    for node in range(1, 2 << depth):
        values[node] = value(node) if node in tree.totals else values[node >> 1]
    return values


def _mean(tree: _Grown) -> Callable[[int], float]:
    return lambda node: tree.totals[node][1] / tree.totals[node][0]


def boost(rows: DataFrame, label: str, features: int, trees: int, depth: int, step: float) -> list[_Grown]:
    """Trees of a boosted sum by squared error: the first one counts in full, the others ``step``."""
    blocks = _blocks(rows, label, features).map(lambda b: (b[0], b[1], np.zeros(len(b[1])))).persist(StorageLevel.MEMORY_AND_DISK)
    grown, before = [], None

    def begun() -> None:
        if before is not None:
            before.unpersist()

    try:
        while True:
            first = not grown
            # the negative gradient of the squared error, of the labels themselves for the first tree
            tree = _regression_tree(blocks.map(lambda b: (b[0], b[1] if first else 2 * (b[1] - b[2]))), depth, begun)
            grown.append(tree)
            if len(grown) == trees:
                return grown
            values = _spread_values(tree, depth, _mean(tree)) * (1.0 if first else step)

            def moved(b, tree=tree, values=values):
                return b[0], b[1], b[2] + values[tree.route(b[0], depth)]

            before, blocks = blocks, blocks.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        begun()
        blocks.unpersist()


def forest(rows: DataFrame, label: str, features: int, classes: int, trees: int, depth: int, seed: int) -> list[_Grown]:
    """Class trees over bootstrap weights, with features drawn for each node."""
    drawn = features if trees == 1 else math.ceil(math.sqrt(features))

    def weighted(number: int, part: Iterator[tuple]) -> Iterator[tuple]:
        draw = np.random.default_rng([seed, number])
        for bins, told in part:
            shape = trees, len(told)
            weights = np.ones(shape) if trees == 1 else np.minimum(draw.poisson(1.0, shape), 255)
            yield bins, told.astype(np.int64), weights.astype(np.uint8)

    blocks = _blocks(rows, label, features).mapPartitionsWithIndex(weighted).persist(StorageLevel.MEMORY_AND_DISK)
    grown = [_Grown(depth) for _ in range(trees)]
    try:
        for level in range(depth + 1):
            opened = [tree.open_nodes(level) for tree in grown]
            if not any(opened):
                break
            # the last level needs the classes only, not by feature
            asked = [np.array([np.sort(np.random.default_rng([seed, t, n]).choice(features, drawn, replace=False)) for n in nodes], dtype=np.int64)
                     .reshape(len(nodes), drawn) for t, nodes in enumerate(opened)]
            slots = []
            for nodes in opened:
                slot_of = np.full(2 << level, -1)
                slot_of[nodes] = np.arange(len(nodes))
                slots.append(slot_of)

            def partial(part: Iterator[tuple]) -> Iterator[tuple]:
                held = {}
                for bins, told, weights in part:
                    for t, tree in enumerate(grown):
                        if not opened[t]:
                            continue
                        rows = np.flatnonzero(weights[t])
                        at = slots[t][tree.route(bins, level)[rows]]
                        inside = at >= 0
                        if not inside.all():
                            rows, at = rows[inside], at[inside]
                        w, y, flat, many = weights[t][rows].astype(float), told[rows], bins.reshape(-1), bins.shape[1]
                        count = len(opened[t])
                        if level == depth:
                            new = np.bincount(at * classes + y, weights=w, minlength=count * classes).reshape(count, 1, 1, classes)
                        else:
                            new = np.empty((drawn, count, MOST_BINS, classes))
                            base = at * (MOST_BINS * classes) + y
                            for j in range(drawn):
                                codes = flat[asked[t][at, j] * many + rows] if count > 1 else bins[asked[t][0, j]][rows]
                                new[j] = np.bincount(base + codes.astype(np.int64) * classes, weights=w, minlength=count * MOST_BINS * classes).reshape(
                                    count, MOST_BINS, classes)
                            new = new.swapaxes(0, 1)
                        held[t] = held[t] + new if t in held else new
                yield from held.items()

            def chosen(entry: tuple) -> tuple:
                t, sums = entry
                totals = sums[:, 0].sum(axis=1)
                if level == depth:
                    return t, totals, [(0, 0, 0.0)] * len(sums)
                return t, totals, [_best(s, _squares, lambda x: x.sum(axis=-1)) for s in sums]

            many = min(trees, max(blocks.ctx.defaultParallelism, 1))
            found = blocks.mapPartitions(partial).reduceByKey(np.add, many).map(chosen).collect()
            if level == 0 and not found:
                raise ValueError("there are no rows to fit on")
            for t, totals, best in found:
                for i, node in enumerate(opened[t]):
                    grown[t].totals[node] = totals[i]
                    feature, cut, gain = best[i]
                    if level < depth and gain > 0 and (totals[i] > 0).sum() > 1:
                        grown[t].split(node, int(asked[t][i, feature]), cut, gain)
    finally:
        blocks.unpersist()
    return [tree for tree in grown if 1 in tree.totals]


# as Spark ML's models ---------------------------------------------------------------


class _Builder:
    """Spark ML's trees of what was grown.  Names are looked up in the JVM once, not for every node."""

    def __init__(self, spark: SparkSession, cuts: list[np.ndarray]):
        ml, self.gateway, self.cuts = spark._jvm.org.apache.spark.ml, spark._sc._gateway, cuts
        impurity = spark._jvm.org.apache.spark.mllib.tree.impurity
        self.regression, self.classification = ml.regression, ml.classification
        self.leaf, self.inner, self.cut = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
        self.variance, self.gini = impurity.VarianceCalculator, impurity.GiniCalculator
        self.vector = spark._jvm.org.apache.spark.mllib.linalg.Vectors.fromJson

    def array(self, kind, values):
        made = self.gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            made[i] = v
        return made

    def doubles(self, values):
        return self.vector(json.dumps({"type": 1, "values": [float(v) for v in values]})).toArray()

    def calculator(self, totals, classes: int | None):
        if classes is None:
            return self.variance(self.doubles(totals[:3]), int(totals[0]))
        return self.gini(self.doubles(totals), int(sum(totals)))

    def told(self, totals, classes: int | None) -> tuple[float, float]:
        """Prediction and impurity of a node."""
        if classes is None:
            rows, told, squares = totals[:3]
            return told / rows, max(squares / rows - (told / rows) ** 2, 0.0)
        return float(np.argmax(totals)), float(1 - ((totals / sum(totals)) ** 2).sum())

    def node(self, tree: _Grown, n: int, classes: int | None) -> tuple:
        """(node, its prediction if it is a leaf)."""
        totals = tree.totals[n]
        prediction, impurity = (float(x) for x in self.told(totals, classes))
        leaf = lambda: (self.leaf(prediction, impurity, self.calculator(totals, classes)), prediction)
        if not tree.splits[n]:
            return leaf()
        (left, a), (right, b) = self.node(tree, 2 * n, classes), self.node(tree, 2 * n + 1, classes)
        if a is not None and a == b:
            return leaf()
        feature = int(tree.feature[n])
        split = self.cut(feature, float(self.cuts[feature][tree.cut[n]]))
        return self.inner(prediction, impurity, float(tree.gain[n]), left, right, split, self.calculator(totals, classes)), None


class BoostedTrees(Estimator):
    """Fits like ``GBTRegressor`` on the ``BINS`` of rows; ``settings`` are its parameters."""

    def __init__(self, cuts: list[np.ndarray], **settings):
        super().__init__()
        self.cuts, self.like = cuts, GBTRegressor(**settings)

    def _fit(self, rows: DataFrame) -> GBTRegressionModel:
        like, many = self.like, len(self.cuts)
        grown = boost(rows, like.getLabelCol(), many, like.getMaxIter(), like.getMaxDepth(), like.getStepSize())
        make = _Builder(rows.sparkSession, self.cuts)
        kind = make.regression.DecisionTreeRegressionModel
        trees = [kind(make.node(tree, 1, None)[0], many) for tree in grown]
        weights = make.doubles([1.0, *[like.getStepSize()] * (len(trees) - 1)])
        made = make.regression.GBTRegressionModel(like.uid, make.array(kind, trees), weights, many)
        return like._copyValues(GBTRegressionModel(made))


class ClassForest(Estimator):
    """Fits like ``RandomForestClassifier`` on the ``BINS`` of rows and an indexed label; ``settings`` are its parameters."""

    def __init__(self, cuts: list[np.ndarray], **settings):
        super().__init__()
        self.cuts, self.like = cuts, RandomForestClassifier(**settings)

    def _fit(self, rows: DataFrame) -> RandomForestClassificationModel:
        like, many = self.like, len(self.cuts)
        classes = max(len(rows.schema[like.getLabelCol()].metadata["ml_attr"]["vals"]), 1)
        grown = forest(rows, like.getLabelCol(), many, classes, like.getNumTrees(), like.getMaxDepth(), like.getSeed())
        make = _Builder(rows.sparkSession, self.cuts)
        kind = make.classification.DecisionTreeClassificationModel
        trees = [kind(make.node(tree, 1, classes)[0], many, classes) for tree in grown]
        made = make.classification.RandomForestClassificationModel(like.uid, make.array(kind, trees), many, classes)
        return like._copyValues(RandomForestClassificationModel(made))
