"""Exact top-k by inner product: everything is scored, global histograms of the scores locate each k-th value.

Queries are taken in blocks of bounded size; the block goes to all tasks, the vectors stay where they are. A pass
scores every vector against the block and counts scores by the leading bits not yet known, within the range that holds
each query's k-th score; a task reports only its highest bins, as many as k scores fill. Summed over all tasks, the
counts fix some more bits. When all bits are known, a last pass keeps the scores above the k-th, and of those equal to
it the smallest ids, as many as are missing; a rank by score and id ends it. No list of candidates is ever held whole.

Components are turned into integers, floor(scale x component), so sums and ties are exact. Vectors with components
so large that a sum could pass 62 bits are multiplied in whole numbers of any size, pair by pair; a score beyond the
range of a long becomes its nearest long. All others are matrix products.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor
does one with a null id; vectors of different length are not compared; of repeated query ids the least vector asks;
repeated candidates count each; rows with the query's own id are left out; fewer than k candidates are all returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stored


@dataclass(frozen=True)
class Settings:
    k: int = 20
    scale: int = 64
    pass_bits: int = 7
    block_queries: int = 4096


LONGS = 1 << 63


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is not less
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.col(id_column).isNotNull()).where(sound).select(
        F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _limit(n: int) -> float:
    """Two vectors of `n` components up to this have an inner product below 2^62."""
    return 2.0 ** ((62 - n.bit_length()) // 2)


def _exact(left: np.ndarray, right: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of all pairs in whole numbers of any size, cut to the range of a long."""
    whole = [[[int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x) for x in row] for row in side.tolist()] for side in (left, right)]
    return np.array([[max(-LONGS, min(LONGS - 1, sum(map(int.__mul__, x, y)))) for y in whole[1]] for x in whole[0]],
                    np.int64).reshape(len(left), len(right))


class _Block:
    """A block of queries, by length of their vectors, and what is known about each k-th score."""

    def __init__(self, rows: list, settings: Settings, most: float):
        self.settings = settings
        self.ids = np.array([r["id"] for r in rows], np.int64)
        lengths = np.array([len(r["v"]) for r in rows])
        self.groups = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        self.vectors = {n: np.array([rows[i]["v"] for i in at], np.float64) for n, at in self.groups.items()}
        # every score lies within +-top; top + score is what the bits are of
        bound = max(n * self._largest(v) * (int(most) * settings.scale + settings.scale) for n, v in self.vectors.items()) if rows else 0
        self.top = min(bound, LONGS)
        self.bits = min(64, max(1, (2 * self.top).bit_length()))
        self.known = self.bits  # bits still unknown
        self.prefix = np.zeros(len(rows), np.uint64)
        self.missing = np.full(len(rows), settings.k, np.int64)

    def _largest(self, vectors: np.ndarray) -> int:
        return int(np.abs(vectors).max()) * self.settings.scale + self.settings.scale

    def _scores(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Inner products of two sets of vectors, as longs."""
        n, scale = left.shape[1], self.settings.scale
        sides, small = [], []
        for side in (left, right):
            with np.errstate(over="ignore"):
                sides.append(np.floor(scale * side))
            small.append(np.abs(sides[-1]).max(axis=1) <= _limit(n))
        (a, b), (p, q) = sides, small
        top = n * int(np.abs(a[p]).max(initial=0)) * int(np.abs(b[q]).max(initial=0))
        kind = np.float32 if top < 2**23 else np.float64 if top < 2**52 else np.int64
        if p.all() and q.all():
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
        scores = np.empty((len(a), len(b)), np.int64)
        scores[np.ix_(p, q)] = (a[p].astype(kind) @ b[q].astype(kind).T).astype(np.int64)
        scores[~p] = _exact(left[~p], right, scale)
        scores[np.ix_(p, ~q)] = _exact(left[p], right[~q], scale)
        return scores

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, candidates' ids, top + score of each pair, and which are pairs (not a query with itself)."""
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            for n, at in self.groups.items():
                here = np.flatnonzero(lengths == n)
                if not len(here):
                    continue
                values = lists.take(pa.array(here)).flatten().to_numpy().reshape(-1, n)
                places = self._scores(self.vectors[n], values).view(np.uint64) + np.uint64(self.top)
                order = np.argsort(self.ids[at], kind="stable")
                found = np.searchsorted(self.ids[at], ids[here], sorter=order)
                found = order[np.minimum(found, len(order) - 1)]
                same = self.ids[at][found] == ids[here]
                pairs = np.ones(places.shape, bool)
                pairs[found[same], np.flatnonzero(same)] = False
                yield at, ids[here], places, pairs

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Highest bins of the next bits, for each query: (query, bin, n)."""
        bits = min(self.known, self.settings.pass_bits)
        shift, bins = self.known - bits, 1 << bits
        counts = np.zeros(len(self.ids) * bins, np.int64)
        for at, _, places, inside in self.scored(batches):
            bin_ = ((places >> np.uint64(shift)) & np.uint64(bins - 1)).astype(np.int64)
            if self.known < self.bits:
                inside = inside & ((places >> np.uint64(self.known)) == self.prefix[at][:, None])
            rows = np.broadcast_to(at[:, None] * bins, places.shape)[inside]
            counts += np.bincount(rows + bin_[inside], minlength=len(counts))
        counts = counts.reshape(len(self.ids), bins)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        query, bin_ = np.nonzero((counts > 0) & (above < self.missing[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(bin_), pa.array(counts[query, bin_])], names=["query", "bin", "n"])

    def narrow(self, counted) -> None:
        """Fix the next bits from the counts of all tasks."""
        bits = min(self.known, self.settings.pass_bits)
        counts = np.zeros((len(self.ids), 1 << bits), np.int64)
        np.add.at(counts, (counted["query"].to_numpy(), counted["bin"].to_numpy()), counted["n"].to_numpy())
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        # the lowest bin that still starts below k scores; bin 0 if there are fewer
        chosen = np.argmax((above < self.missing[:, None]) & (above + counts >= self.missing[:, None]), axis=1)
        short = above[:, 0] + counts[:, 0] < self.missing
        chosen[short] = 0
        self.missing = self.missing - above[np.arange(len(self.ids)), chosen]
        self.prefix = self.prefix << np.uint64(bits) | chosen.astype(np.uint64)
        self.known -= bits

    def keep(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, vec_id, score) above the k-th score, and the smallest ids at it."""
        ties: dict[int, np.ndarray] = {}

        def record(query, ids, places):
            return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(ids), pa.array((places - np.uint64(self.top)).view(np.int64))],
                                              names=["query_id", "vec_id", "score"])

        for at, ids, places, pairs in self.scored(batches):
            row, column = np.nonzero(pairs & (places > self.prefix[at][:, None]))
            yield record(at[row], ids[column], places[row, column])
            row, column = np.nonzero(pairs & (places == self.prefix[at][:, None]))
            for r in np.unique(row):
                query = int(at[r])
                ours = np.concatenate([ties.get(query, ids[:0]), ids[column[row == r]]])
                ties[query] = np.sort(ours)[: self.missing[query]]
        for query, ids in ties.items():
            yield record(np.full(len(ids), query), ids, np.full(len(ids), self.prefix[query], np.uint64))


def top_k(vectors: DataFrame, is_query: Column, settings: Settings = Settings(), id_column: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller id."""
    spark = vectors.sparkSession
    candidates = usable(vectors, id_column, vector)
    queries = usable(vectors.where(is_query), id_column, vector).groupBy("id").agg(F.min("v").alias("v"))
    number = queries.count()
    most = candidates.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    size = -(-number // settings.block_queries) or 1
    if size > 1:
        queries = stored(queries)
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for part in range(size):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(size)) == part).orderBy("id").collect()
        if not rows:
            continue
        block = _Block(rows, settings, most)
        while block.known:
            counted = candidates.mapInArrow(block.count, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
            block.narrow(counted.toPandas())
        kept = candidates.mapInArrow(block.keep, "query_id long, vec_id long, score long")
        # written before the next block is read, so that the driver holds the vectors of one block
        found = found.unionByName(stored(kept) if size > 1 else kept)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.k).select(
        "query_id", "rank", "vec_id", "score")
