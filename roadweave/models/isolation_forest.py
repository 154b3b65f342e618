"""Isolation forest (Liu, Ting, Zhou 2008) as a Spark job.

Every tree sees a sample of at most 256 rows, so growing the trees is small and parallel
(one group per tree) however large the data is.  The grown forest is a table of at most
``trees * 511`` nodes; it travels to the executors with the scoring function, and all rows
are scored in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave import fixed_values as fv

NODE = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def mean_path(n) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of ``n`` keys."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, rows: np.ndarray, seed: int) -> pd.DataFrame:
    draw, nodes = np.random.default_rng([seed, tree]), []
    limit = math.ceil(math.log2(max(len(rows), 2)))
    waiting = [(rows, 0, -1, False)]
    while waiting:
        part, depth, parent, is_right = waiting.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = number
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(open_features) == 0:
            nodes.append([number, -1, 0.0, -1, -1, len(part), depth])
            continue
        feature = int(draw.choice(open_features))
        threshold = float(draw.uniform(low[feature], high[feature]))
        nodes.append([number, feature, threshold, -1, -1, len(part), depth])
        under = part[:, feature] < threshold
        waiting.append((part[~under], depth + 1, number, True))
        waiting.append((part[under], depth + 1, number, False))
    grown = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    grown.insert(0, "tree", tree)
    return grown


def train(features: DataFrame, identity: str, columns: list[str] | None = None, trees: int = 100,
          sample_rows: int = 256, seed: int = 42) -> DataFrame:
    """Grow the forest; returns its node table.

    The rows drawn are the ``trees * sample_rows`` with the smallest hash of their id: every
    task keeps only that many, and the choice does not change when a task is repeated.  In the order
    of their hashes they are dealt out like a ring: each tree takes the next ``sample_rows``, so all trees
    have exactly as many, and of a table smaller than the draw rows are used by several trees.
    """
    columns = columns or fv.ANOMALY_FEATURES
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    drawn = (
        features.select(F.xxhash64(F.col(identity), F.lit(seed)).alias("_draw"), *values)
        .orderBy("_draw", *columns).limit(trees * sample_rows)
    )
    # a window over the rows drawn, which are bounded
    ring = Window.orderBy("_draw", *columns)
    ranked = drawn.withColumn("_rank", F.row_number().over(ring) - 1).withColumn("_drawn", F.count(F.lit(1)).over(Window.partitionBy()))
    takes = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.col("_rank") - t * sample_rows, F.col("_drawn")) < sample_rows)
    dealt = ranked.withColumn("_tree", F.explode(takes)).drop("_rank", "_drawn")

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["_draw", *columns])[columns].to_numpy()
        return _grow(int(group["_tree"].iloc[0]), rows, seed)

    return dealt.groupBy("_tree").applyInPandas(grow, NODE)


def score(features: DataFrame, forest: DataFrame, columns: list[str] | None = None,
          output: str = "anomaly_score") -> DataFrame:
    """Add the decision score: below 0 is an anomaly, the lower the stranger.

    ``forest`` is bounded by the tree count, not by the data, so it is read on the driver.  Only the model's columns
    go to Python; all others stay where they are.
    """
    columns = columns or fv.ANOMALY_FEATURES
    table = forest.orderBy("tree", "node").toPandas()
    grown = [g.drop(columns="tree").to_numpy() for _, g in table.groupby("tree")]
    sample = mean_path(np.mean([g[0, 5] for g in grown]))

    def prepared(nodes: np.ndarray) -> tuple:
        """A tree in which a row that is at a leaf stays there, so that all rows can go down together without exceptions."""
        feature, own = nodes[:, 1].astype(int), np.arange(len(nodes))
        inner = feature >= 0
        # children in pairs: not below the threshold, below it
        children = np.stack([np.where(inner, nodes[:, 4], own), np.where(inner, nodes[:, 3], own)], axis=1).astype(int).reshape(-1)
        return np.where(inner, feature, 0), nodes[:, 2], children, nodes[:, 6] + mean_path(nodes[:, 5]), int(nodes[:, 6].max())

    trees = [prepared(nodes) for nodes in grown]

    def depths(tree: tuple, values: np.ndarray, rows: int) -> np.ndarray:
        """Of each row; ``values`` has one feature after the other."""
        feature, threshold, children, leaf_depth, levels = tree
        at, here = np.zeros(rows, dtype=int), np.arange(rows)
        for _ in range(levels):
            at = children[2 * at + (values[feature[at] * rows + here] < threshold[at])]
        return leaf_depth[at]

    @F.pandas_udf("double")
    def scores(batch: pd.DataFrame) -> pd.Series:
        rows = batch.astype(float).fillna(0.0).to_numpy()
        values = np.ascontiguousarray(rows.T).reshape(-1)
        mean_depth = np.mean([depths(tree, values, len(rows)) for tree in trees], axis=0) if len(rows) else np.zeros(0)
        return pd.Series(0.5 - np.power(2.0, -mean_depth / sample))

    return features.withColumn(output, scores(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))


def is_anomaly(score_column, closed, drop_pct):
    """Flagged by the forest and backed by a real signal."""
    backed = (score_column < -0.05) | F.coalesce(closed, F.lit(False)) | (drop_pct > 30)
    return (score_column < 0) & backed

