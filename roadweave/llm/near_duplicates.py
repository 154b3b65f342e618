"""Near-duplicates: improved consistent weighted sampling (ICWS) over TF-IDF word shingles, banded and verified.

1. Shingles of five words (a shorter text is one shingle) get the weight tf x idf; idf is bounded, so that it only
   lowers shingles of more than half of all texts. Document frequencies are counted over all rows in a hashed table
   of fixed size: each task counts, a shuffle adds the pieces up.
2. One pass draws `bands` x `rows` ICWS samples of each text; rows of equal texts become one node (by digest).
3. Nodes that share a band are candidates. First each is compared with one node of its band only, and links form
   components. Where a band still holds several components, the nodes outside its largest one are compared with two
   more of that one's nodes. What is outside then is compared with the band's nodes of other components: by pairs in
   bands of up to SMALL nodes, in blocks of texts in larger ones; a pair is left to the first band it shares. So every
   pair that shares a band is in one component or was compared: no link is lost, and groups of copies, whatever their
   size, do not become pairs.
4. Candidates are verified by the weighted Jaccard similarity of their whole texts; links form components by
   alternating large-star and small-star steps; a class is named by its least doc_id and its least digest: the
   digest tells classes apart, as ids may be null or repeat over different texts.

A pair of similarity s shares no band with probability (1 - s^rows)^bands: 2e-4 at 0.8, 3e-6 at 0.87; that its samples
tell it apart from a pair of 0.8 by chance has probability 3e-5.

Defined cases: null texts are each their own class (named by their doc_id); empty texts are copies of each other and
near nothing else; rows of equal text are one class, also with equal or null ids; a text is used whole. Case and the
kind of white space do not matter for similarity. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField

from roadweave.llm.common import blocks, stored, with_results

PIECES = 64
HASH_BITS = 52
"""A sorted key holds the text's number in its block above a shingle hash of this many bits."""
SMALL, BLOCK = 64, 128
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    df_bits: int = 18
    least_alike: float = 0.6
    """Pairs with a smaller share of equal samples are not verified: of 64 samples, four standard deviations below 0.8."""


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < size:
        base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64)
                        for b in (base, inverse))
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the number of words of each text."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    edges = np.diff((data > 32).view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverses[starts])
    bounds = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of up to 4096 texts: number of the text, hash, occurrences; sorted by text and hash."""
    hashes, number = word_hashes(texts)
    first = np.cumsum(number) - number
    made = np.where(number >= words, number - words + 1, np.minimum(number, 1))
    owner = np.repeat(np.arange(len(texts)), made)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made) + first[owner]
    left = np.minimum(number, words)[owner]
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    value = np.zeros(len(owner), np.uint64)
    for i in range(words):
        value = np.where(i < left, mix64(value * _ODD + padded[at + i]), value)
    keys = np.sort(owner.astype(np.uint64) << np.uint64(HASH_BITS) | value >> np.uint64(64 - HASH_BITS))
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    keys, times = keys[new], np.diff(new, append=len(keys))
    return (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1), times


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    for first, last in blocks(texts):
        for at in range(first, last, 4096):
            yield at, min(last, at + 4096)


def document_frequencies(texts: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """idf by hashed shingle, from all texts: log(1 + texts / texts that hold the bucket), at most that of half the texts.

    Without the bound, what a large group of near-copies shares would weigh less than what its members differ in, and
    the group would fall apart. So only shingles of more than half of all texts, which tell nothing, lose weight.
    """
    size = 1 << settings.df_bits
    width = size // PIECES

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, rows = np.zeros(size, np.int32), 0
        for frame in frames:
            own = frame["text"].tolist()
            rows += len(own)
            for first, last in _blocks(own):
                _, hashes, _ = shingles(own[first:last], settings.words)
                counts += np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.int32)
        if rows:
            yield pd.DataFrame({"piece": np.arange(PIECES), "texts": rows, "counts": list(counts.reshape(PIECES, width))})

    def total(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, rows = np.zeros(width, np.int64), 0
        for frame in frames:
            for own in frame["counts"]:
                counts += own
            rows += int(frame["texts"].sum())
        yield pd.DataFrame({"piece": [key[0]], "texts": [rows], "counts": [counts]})

    counted = texts.where("text IS NOT NULL").select("text").mapInPandas(count, "piece int, texts long, counts array<int>")
    rows = counted.groupBy("piece").applyInPandas(total, "piece int, texts long, counts array<long>").toPandas()
    counts, number = np.zeros(size), 1
    for piece, texts_here, own in rows.itertuples(index=False):
        counts[piece * width : (piece + 1) * width] = own
        number = max(number, texts_here)
    return np.log1p(np.minimum(number / np.maximum(counts, 1), 2.0)).astype(np.float32)


def _weights(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return times.astype(np.float32) * idf[(hashes & np.uint64(len(idf) - 1)).astype(np.int64)]


def _gamma_table() -> np.ndarray:
    """65,536 equally likely values of Gamma(2, 1): its quantiles, by bisection of 1 - (1 + x) exp(-x)."""
    wanted = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < wanted
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return ((low + high) / 2).astype(np.float32)


_GAMMA = _gamma_table()
_LOG_GAMMA = np.log(_GAMMA)
_16 = np.uint64(0xFFFF)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, number: int) -> np.ndarray:
    """ICWS: `number` samples of each weighted set; a set is the range from one start to the next.

    For an element of weight w: r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), all from the element and the sample's number;
    t = floor(log w / r + b); the element with the least log c - r (t + 1 - b) is drawn, as (element, t).
    """
    log_weights, drawn = np.log(weights), np.empty((len(starts), number), np.uint32)
    for k in range(number):
        bits = mix64(hashes + np.uint64((k + 1) * int(_ODD) & (1 << 64) - 1))
        r = _GAMMA[(bits & _16).astype(np.int32)]
        log_c = _LOG_GAMMA[(bits >> np.uint64(16) & _16).astype(np.int32)]
        b = (bits >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weights / r + b)
        order = (log_c - r * (t + 1 - b)).view(np.int32).astype(np.int64)
        order ^= order >> np.int64(63) & np.int64(0x7FFFFFFF)  # integers in the order of the floats
        name = (bits ^ t.astype(np.int64).view(np.uint64) * _ODD) >> np.uint64(24) & np.uint64(0xFFFFFFFF)
        key = (order + np.int64(1 << 31)).astype(np.uint64) << np.uint64(32) | name
        drawn[:, k] = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return drawn


def sketches(texts: list[str], idf: np.ndarray, settings: Settings) -> tuple[list, list]:
    """For each text, its samples and one 64-bit key for each band; none for a text without words."""
    drawn, keys = [[] for _ in texts], [[] for _ in texts]
    for first, last in _blocks(texts):
        owner, hashes, times = shingles(texts[first:last], settings.words)
        if not len(owner):
            continue
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        own = samples(hashes, _weights(hashes, times, idf), starts, settings.bands * settings.rows)
        parts = own.astype(np.uint64).reshape(len(starts), settings.bands, settings.rows)
        key = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), parts.shape[:2])
        for i in range(settings.rows):
            key = mix64(key * _ODD + parts[:, :, i])
        for text, s, k in zip(owner[starts] + first, own.view(np.int32), key.view(np.int64)):
            drawn[text], keys[text] = s, k
    return drawn, keys


def weighted_jaccard(left: list[str], right: list[str], idf: np.ndarray, settings: Settings) -> np.ndarray:
    """Sum of the lesser over the sum of the greater weights, pair by pair."""
    result = np.zeros(len(left))
    for first, last in _blocks([a + b for a, b in zip(left, right)]):
        sides = [shingles(own[first:last], settings.words) for own in (left, right)]
        weights = [_weights(h, t, idf).astype(np.float64) for _, h, t in sides]
        keys = np.concatenate([o.astype(np.uint64) << np.uint64(HASH_BITS) | h for o, h, _ in sides])
        order = np.argsort(keys, kind="stable")
        keys, weight, owner = keys[order], np.concatenate(weights)[order], np.concatenate([o for o, _, _ in sides])[order]
        both = np.flatnonzero(keys[1:] == keys[:-1])
        common = np.bincount(owner[both], np.minimum(weight[both], weight[both + 1]), last - first)
        union = np.bincount(owner, weight, last - first) - common
        result[first:last] = np.where(union > 0, common / np.maximum(union, 1e-300), 0)
    return result


def similarities(left: list[str], right: list[str], idf: np.ndarray, settings: Settings) -> np.ndarray:
    """Weighted Jaccard similarity of each left to each right text, by one matrix product.

    The n-th occurrence of a shingle is a feature of its own, so the lesser of two counts is a sum of products.
    """
    owner, hashes, times = shingles([*left, *right], settings.words)
    weight = idf[(hashes & np.uint64(len(idf) - 1)).astype(np.int64)].astype(np.float64)
    sums = np.bincount(owner, weight * times, len(left) + len(right))
    # only what both sides hold can be common
    shared = np.intersect1d(hashes[owner < len(left)], hashes[owner >= len(left)])
    at = np.minimum(np.searchsorted(shared, hashes), max(len(shared) - 1, 0))
    met = np.flatnonzero(shared[at] == hashes) if len(shared) else np.empty(0, np.int64)
    often = np.repeat(met, times[met])
    nth = np.arange(len(often)) - np.repeat(np.cumsum(times[met]) - times[met], times[met])
    keys, column = np.unique(np.stack([at[often], nth]), axis=1, return_inverse=True)
    table = np.zeros((len(sums), keys.shape[1]))
    table[owner[often], column.ravel()] = np.sqrt(weight[often])
    common = table[: len(left)] @ table[len(left) :].T
    union = sums[: len(left), None] + sums[None, len(left) :] - common
    return np.where(union > 0, common / np.maximum(union, 1e-300), 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b), the root being the least node of its component."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # done when every node points to one root, and no root points on
        ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            edges.select(F.col("b").alias("k"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        open_ = ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 AND out > 0")
        if open_.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                       .unionByName(least.select("a", F.col("m").alias("b"))).distinct())


class _Search:
    """The rounds of comparing nodes that share a band."""

    def __init__(self, docs: DataFrame, settings: Settings):
        self.settings = settings
        rows = docs.select("doc_id", "text")
        self.idf = idf = document_frequencies(rows, settings)

        def sketch(texts: list[str | None]) -> list:
            """Equal texts of a batch are sampled once."""
            distinct = list(dict.fromkeys(t for t in texts if t is not None))
            made = dict(zip(distinct, zip(*sketches(distinct, idf, settings))))
            return [[None if t is None else made[t][i] for t in texts] for i in (0, 1)]

        sketched = with_results(rows.withColumn("digest", F.md5(F.col("text").cast("binary"))), ["text"],
                                [StructField("samples", ArrayType(IntegerType())), StructField("bands", ArrayType(LongType()))], sketch)
        self.rows = stored(sketched.select("doc_id", "digest", "samples", "bands"))
        self.nodes = stored(self.rows.where("digest IS NOT NULL").groupBy("digest")
                            .agg(F.min("doc_id").alias("holder"), F.count("*").alias("copies"), F.first("samples").alias("samples"),
                                 F.first("bands").alias("bands"))
                            .withColumn("node", F.monotonically_increasing_id()))
        members = self.nodes.select(F.posexplode("bands").alias("place", "band"), "node")
        shared = members.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
        self.members = stored(members.join(shared, "band").select("band", "place", "node", "least"))
        wanted = self.nodes.join(self.members.select("node").distinct(), "node", "left_semi").select(
            "node", "digest", "holder", "copies")
        key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("digest", "doc_id")]
        texts = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).where("digest IS NOT NULL")
        held = stored(texts.select(F.concat(*key).alias("key"), "text").join(
            wanted.select("node", "copies", F.concat("digest", F.coalesce(F.col("holder").cast("string"), F.lit(""))).alias("key")), "key")
            .select("node", "copies", "text"))
        # rows may repeat with their ids: one text stands for a node
        repeated = stored(held.where("copies > 1").select("node", "text").dropDuplicates(["node"]))
        self.texts = held.where("copies = 1").select("node", "text").unionByName(repeated)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough; the texts of those whose samples tell it apart are not read."""
        idf, settings = self.idf, self.settings
        own = self.nodes.select("node", "samples")
        alike = F.aggregate(F.zip_with("s", "t", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        likely = pairs.select("a", "b").join(own.withColumnsRenamed({"node": "a", "samples": "s"}), "a").join(
            own.withColumnsRenamed({"node": "b", "samples": "t"}), "b").where(
            alike >= settings.least_alike * settings.bands * settings.rows).select("a", "b")
        texts = likely.join(self.texts.withColumnsRenamed({"node": "a", "text": "left"}), "a").join(
            self.texts.withColumnsRenamed({"node": "b", "text": "right"}), "b")
        scored = with_results(texts.select("a", "b", "left", "right"), ["left", "right"], [StructField("similarity", DoubleType())],
                              lambda left, right: [weighted_jaccard(left, right, idf, settings)])
        return scored.where(F.col("similarity") >= settings.similarity).select("a", "b").distinct()

    def classes(self) -> DataFrame:
        """(node, root) of all nodes with a link."""
        stars = self.members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
        roots = stored(components(self.links(stars)))
        roots = self._merged(roots, self._second_stars(self._mixed(roots)))
        mixed = self._mixed(roots)
        return self._merged(roots, self._in_small_bands(mixed.where(F.col("n") <= SMALL)).unionByName(
            self._in_large_bands(mixed.where(F.col("n") > SMALL))).distinct())

    def _mixed(self, roots: DataFrame) -> DataFrame:
        """Members of bands with several components: `base` is the largest, nodes outside it are `open`."""
        members = self.members.join(roots, "node", "left").select("band", "place", "node", F.coalesce("root", "node").alias("root"))
        kinds = members.groupBy("band", "root").agg(
            F.count("*").alias("n"), F.max("node").alias("last"), F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node")).alias("any"))
        bands = kinds.groupBy("band").agg(F.max(F.struct("n", "root", "last", F.col("any.node").alias("any"))).alias("base"),
                                          F.count("*").alias("kinds"), F.sum("n").alias("n")).where("kinds > 1")
        bands = bands.select("band", "n", F.col("base.n").alias("most"), F.col("base.root").alias("base"), "base.last", "base.any")
        return stored(members.join(bands, "band").withColumn("open", F.col("root") != F.col("base")))

    def _merged(self, roots: DataFrame, links: DataFrame) -> DataFrame:
        """Roots after links (a, b) between them."""
        links = stored(links)
        if links.isEmpty():
            return roots
        joined = stored(components(links)).select(F.col("node").alias("root"), F.col("root").alias("new"))
        return stored(roots.join(joined, "root", "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(
            joined.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("new").alias("root"))))

    def _second_stars(self, mixed: DataFrame) -> DataFrame:
        """Links between roots, from comparing open nodes with two nodes of their bands' largest components."""
        pairs = mixed.where("open").select(F.col("node").alias("a"), "root", "base", F.explode(F.array_distinct(F.array("last", "any"))).alias("b"))
        pairs = pairs.groupBy("a", "b").agg(F.first("root").alias("root"), F.first("base").alias("base"))
        return self.links(pairs).join(pairs, ["a", "b"]).select(F.col("root").alias("a"), F.col("base").alias("b")).distinct()

    def _in_blocks(self, rows: DataFrame, fields: list[str]) -> DataFrame:
        """(place, left, right): a band's open nodes and all its nodes, in lists of about BLOCK."""
        def lists(side: DataFrame, size: Column, name: str) -> DataFrame:
            block = F.pmod(F.xxhash64("node"), F.ceil(size / BLOCK)).alias("block")
            return side.select("band", "place", block, F.struct(*fields).alias("x")).groupBy("band", "place", "block").agg(
                F.collect_list("x").alias(name)).drop("block")

        return lists(rows.where("open"), F.col("n") - F.col("most"), "left").join(
            lists(rows, F.col("n"), "right").drop("place"), "band").select("place", "left", "right")

    def _candidates(self, batch: pa.RecordBatch, i: int) -> tuple[list[pa.Array], np.ndarray, list[np.ndarray]]:
        """Of a row of blocks: the nodes of both sides, which pairs are likely and first met in this band, their roots."""
        settings = self.settings
        sides = [batch.column(k)[i].values for k in (1, 2)]
        (root, x), (other, y) = ((p.field("root").to_numpy(), p.field("samples").flatten().to_numpy().reshape(len(p), -1)) for p in sides)
        kept = np.zeros((len(root), len(other)), bool)
        for j in range(len(root)):
            same = x[j] == y
            band = same.reshape(len(other), settings.bands, settings.rows).all(axis=2)
            kept[j] = (same.mean(axis=1) >= settings.least_alike) & (band.argmax(axis=1) == batch.column(0)[i].as_py()) & (other != root[j])
        return sides, kept, [root, other]

    def _in_small_bands(self, mixed: DataFrame) -> DataFrame:
        """Links (a, b) between roots: likely pairs first, then their texts."""
        candidates = _detached(self)._candidates
        rows = mixed.join(self.nodes.select("node", "samples"), "node")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[np.ndarray] = [np.empty((4, 0), np.int64)]
                for i in range(batch.num_rows):
                    (left, right), kept, (root, other) = candidates(batch, i)
                    a, b = np.nonzero(kept)
                    found.append(np.stack([left.field("node").to_numpy()[a], right.field("node").to_numpy()[b], root[a], other[b]]))
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in np.concatenate(found, axis=1)], names=["a", "b", "root", "other"])

        pairs = stored(self._in_blocks(rows, ["node", "root", "samples"]).mapInArrow(
            compare, "a long, b long, root long, other long").distinct())
        return self.links(pairs).join(pairs, ["a", "b"]).select(F.col("root").alias("a"), F.col("other").alias("b"))

    def _in_large_bands(self, mixed: DataFrame) -> DataFrame:
        """Links (a, b) between roots: blocks of texts are compared at once, so that likely pairs need no rows."""
        idf, settings, candidates = self.idf, self.settings, _detached(self)._candidates
        rows = mixed.join(self.nodes.select("node", "samples"), "node").join(self.texts, "node")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[np.ndarray] = [np.empty((2, 0), np.int64)]
                for i in range(batch.num_rows):
                    sides, kept, (root, other) = candidates(batch, i)
                    if kept.any():
                        a, b = np.nonzero(kept)
                        values = similarities(*(p.field("text").to_pylist() for p in sides), idf, settings)[a, b]
                        near = values >= settings.similarity
                        found.append(np.unique(np.stack([root[a[near]], other[b[near]]]), axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in np.concatenate(found, axis=1)], names=["a", "b"])

        spark = mixed.sparkSession
        held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row holds two blocks of texts
        try:
            return stored(self._in_blocks(rows, ["node", "root", "samples", "text"]).mapInArrow(compare, "a long, b long").distinct())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def _detached(search: _Search) -> _Search:
    """What tasks need of a search: no tables."""
    part = object.__new__(_Search)
    part.settings = search.settings
    return part


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, digest, class_id, class_digest, class_rows) for every row of `docs`; no two classes share a class_digest."""
    search = _Search(docs, settings)
    roots = search.classes()
    named = search.nodes.select("digest", "node").join(roots, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("root"))
    rows = search.rows.select("doc_id", "digest").join(named, "digest", "left")
    sizes = rows.where("root IS NOT NULL").groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.min("digest").alias("class_digest"), F.count("*").alias("class_rows"))
    return rows.join(sizes, "root", "left").select(
        "doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "class_digest", F.coalesce("class_rows", F.lit(1)).alias("class_rows"))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class with all columns of `docs`: that of the least doc_id, then digest, then the other columns
    in their order (maps as JSON), nulls first; rows without text stay."""
    key = F.concat(F.md5(F.col("text").cast("binary")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kept = near_duplicates(docs, settings).where("digest IS NOT NULL").groupBy("class_digest").agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest")).alias("row"))
    kept = kept.select(F.concat("row.digest", F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))).alias("__key"))
    named = docs.withColumn("__key", key)
    rest = named.where("__key IS NULL")
    rows = named.join(kept, "__key", "left_semi")
    order = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
             for f in docs.schema if f.name not in ("doc_id", "text")]
    whole = F.struct(*[f"`{c}`" for c in docs.columns])
    least = rows.groupBy("__key").agg(F.min_by(whole, F.struct(F.lit(0).alias("first"), *order)).alias("row")).select("row.*")
    return least.unionByName(rest.drop("__key"))
