"""Substring dedup by seed and extend: passages of LENGTH words that a document of smaller doc_id also holds.

Seeds: of the SEED-word grams of every LENGTH-word window the one of least hash is its anchor (winnowing), so the equal
windows of two documents have the same anchor at the same place.  Anchors are counted over all documents; those that
occur in one document only are done with.  Extension: each occurrence of another anchor carries the fingerprints of the
windows it is the anchor of, in order: how far the text agrees to the left and to the right of the seed is how far these
agree.  Every occurrence is extended against one partner, the anchor's occurrence in the least document; the agreeing
run is a maximal repeat within reach of the seed, and runs of neighbouring seeds join to longer ones.  Windows that the
partner does not share are looked up by anchor and fingerprint among all windows left over in this way, so that repeats
between other documents are found too, without pairing the occurrences of an anchor with each other.

Windows equal in anchor and fingerprint (128 bits) count as equal.  Rows of one doc_id and text (by two 64-bit hashes)
are judged once.

Defined results: a null text has no words.  A null doc_id is never smaller or larger than another: its row loses nothing
and takes nothing.  Rows that repeat a doc_id, with the same text or another, take nothing from each other.  A text below
LENGTH words is kept.  No documents: no rows.  Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import blocks, stored

LENGTH = 50
SEED = 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place on, of 64-bit word hashes."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    size = 1 << len(words).bit_length()
    up, down = _powers(int(BASE), size), _powers(pow(int(BASE), -1, 1 << 64), size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mixed64((sums[length:] - sums[:-length]) * down[: len(words) - length + 1] + np.uint64(length))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` consecutive values; the first of equal ones."""
    places, reach = np.arange(len(values)), 1

    def join(step: int) -> None:
        nonlocal values, places
        later = values[step:] < values[:-step]
        values, places = np.where(later, values[step:], values[:-step]), np.where(later, places[step:], places[:-step])

    while 2 * reach <= width:
        join(reach)
        reach *= 2
    if width > reach:
        join(width - reach)
    return places


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin and end."""
    split = [text.split() for text in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(words) for words in split], out=bounds[1:])
    flat = np.empty(bounds[-1], object)
    flat[:] = [word for words in split for word in words]
    return pd.util.hash_array(flat), bounds


class Anchors:
    """Anchors of some texts: hash, place, first window and number of windows of each, in order of the texts."""

    def __init__(self, texts: list[bytes]):
        hashes, bounds = word_hashes(texts)
        self.grams = run_hashes(hashes, SEED)
        self.windows = run_hashes(hashes, LENGTH)
        sizes = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = bounds[text_of] + within
        places = least_places(self.grams, LENGTH - SEED + 1)[starts] if len(starts) else np.empty(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (places[1:] != places[:-1]) | (text_of[1:] != text_of[:-1])
        first = np.flatnonzero(new)
        self.text, self.place, self.start = text_of[first], places[first], starts[first]
        self.count = np.diff(np.append(first, len(starts)))
        self.anchor = self.grams[self.place].view(np.int64)
        self.bounds = bounds
        self.cuts = np.searchsorted(self.text, np.arange(len(texts) + 1))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [raw or b"" for raw in batch.column(3).to_pylist()]
        lists = []
        for a, b in blocks(texts):
            found = Anchors(texts[a:b])
            lists += [np.unique(found.anchor[x:y]) for x, y in zip(found.cuts, found.cuts[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "anchors"])


SIGNED = "doc_id bigint, k1 bigint, k2 bigint, anchor bigint, least bigint, start int, left int, marks array<bigint>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the anchors they share -> each occurrence of these, with the fingerprints of its windows."""
    for batch in batches:
        ids = [batch.column(i).to_numpy() for i in range(3)]
        texts, shared = batch.column(3).to_pylist(), batch.column(4)
        for a, b in blocks(texts):
            found, rows, leasts = Anchors(texts[a:b]), [], []
            for i in range(a, b):
                known = shared[i].values
                anchors, least = known.field(0).to_numpy(), known.field(1).to_numpy()
                order = np.argsort(anchors)
                x, y = found.cuts[i - a], found.cuts[i - a + 1]
                at = np.minimum(np.searchsorted(anchors, found.anchor[x:y], sorter=order), len(anchors) - 1)
                hit = anchors[order[at]] == found.anchor[x:y]
                rows.append(np.flatnonzero(hit) + x)
                leasts.append(least[order[at[hit]]])
            rows, leasts = np.concatenate(rows), np.concatenate(leasts)
            text, count, start = found.text[rows], found.count[rows], found.start[rows]
            offsets = np.concatenate([[0], np.cumsum(count)])
            marks = found.windows[np.repeat(start - offsets[:-1], count) + np.arange(offsets[-1])].view(np.int64)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(k[a:b][text]) for k in ids), pa.array(found.anchor[rows]), pa.array(leasts),
                pa.array((start - found.bounds[text]).astype(np.int32)), pa.array((found.place[rows] - start).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(marks))],
                names=["doc_id", "k1", "k2", "anchor", "least", "start", "left", "marks"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, raw text and a key of both."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return raw.select("doc_id", F.xxhash64("doc_id", "raw").alias("k1"), F.xxhash64(F.lit(7), "raw", "doc_id").alias("k2"), "raw")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur in two documents or more, with the least of these.

    Written, as are the partners below: joined to a table, a key that a third of all rows share is split at run time;
    joined to a grouping by the same key it would be one task.
    """
    both = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return stored(both.where("least < most").select(*keys, "least"))


def _extended(signed: DataFrame) -> DataFrame:
    """Occurrences against their anchor's occurrence in the least document: the agreeing run, and the windows left over."""
    partner = stored(signed.where("doc_id = least").groupBy("anchor").agg(F.min_by(
        F.struct("k1", "k2", "start", "left", "marks"), F.struct("k1", "k2", "start")).alias("p")))
    pairs = signed.join(partner, "anchor").where("NOT (k1 = p.k1 AND k2 = p.k2 AND start = p.start)")
    # window i of the occurrence lies as its partner's window i + p.left - left
    agrees = F.expr("""filter(sequence(0, size(marks) - 1), i -> i + p.left - left >= 0 AND i + p.left - left < size(p.marks)
        AND marks[i] = p.marks[greatest(least(i + p.left - left, size(p.marks) - 1), 0)])""")
    pairs = pairs.withColumn("run", agrees)
    left_over = F.expr("filter(transform(marks, (m, i) -> struct(m AS mark, start + i AS at)), (m, i) -> NOT array_contains(run, i))")
    return pairs.select("k1", "k2", "doc_id", "least", "anchor",
                        F.expr("start + array_min(run)").alias("first"), F.expr("start + array_max(run)").alias("last"), left_over.alias("rest"))


def repeats(docs: DataFrame) -> DataFrame:
    """Documents that hold repeats (k1, k2 of `keyed`), with the ranges of window starts that smaller documents share."""
    own = keyed(docs).where("doc_id IS NOT NULL")
    seeds = stored(own.mapInArrow(_seeds, "doc_id bigint, k1 bigint, k2 bigint, anchors array<bigint>"))
    each = seeds.select("doc_id", "k1", "k2", F.explode("anchors").alias("anchor"))
    shared = _shared(each, "anchor")
    wanted = each.select("k1", "k2", "anchor").join(shared, "anchor").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("anchor", "least")).alias("shared"))
    signed = stored(own.join(wanted, ["k1", "k2"]).select("doc_id", "k1", "k2", "raw", "shared").mapInArrow(_signed, SIGNED))
    extended = stored(_extended(signed))
    runs = extended.where("first IS NOT NULL AND doc_id > least").select("k1", "k2", "first", "last")
    rest = extended.select("k1", "k2", "doc_id", "anchor", F.explode("rest").alias("w")).select("k1", "k2", "doc_id", "anchor", "w.*")
    others = rest.join(_shared(rest, "anchor", "mark"), ["anchor", "mark"]).where("doc_id > least").select(
        "k1", "k2", F.col("at").alias("first"), F.col("at").alias("last"))
    return runs.unionByName(others).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, text string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column(2)
        counts, removed, texts = [], [], []
        for i, raw in enumerate(batch.column(1).to_pylist()):
            words = (raw or b"").split()
            counts.append(len(words))
            gone = 0
            if runs[i].is_valid:
                known = runs[i].values
                steps = np.bincount(known.field(0).to_numpy(), minlength=len(words) + 1).astype(np.int64)
                steps -= np.bincount(known.field(1).to_numpy() + LENGTH, minlength=len(words) + 1)
                stays = np.cumsum(steps)[:-1] == 0
                gone = len(words) - int(stays.sum())
                words = list(compress(words, stays.tolist()))
            removed.append(gone)
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Each document's words, removed words, and the text that is left, its words joined by one space."""
    marked = keyed(docs).join(repeats(docs), ["k1", "k2"], "left")
    return marked.select("doc_id", "raw", "runs").mapInArrow(_kept, KEPT)


REPEATS_SQL = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, s, md5(array_to_string(words[s:s + {LENGTH - 1}], ' ')) AS h
    FROM w, unnest(range(1, len(words) - {LENGTH - 2})) AS t(s)),
l AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
b AS (SELECT DISTINCT r, p FROM (SELECT r, s FROM s JOIN l USING (h) WHERE doc_id > least) AS x, unnest(range(s, s + {LENGTH})) AS t(p)),
p AS (SELECT w.r, t.p, words[t.p] AS word, b.p IS NULL AS stays FROM w, unnest(range(1, len(words) + 1)) AS t(p) LEFT JOIN b ON b.r = w.r AND b.p = t.p),
k AS (SELECT r, count(*) FILTER (NOT stays) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (stays), '') AS kept FROM p GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)"""
