"""Filter interaction audit: what each order of five filters would remove, from one truth table a document.

A document becomes a 32-bit word: bit S is set if it survives the subset S of the filters, so all 120 orders and all
interactions are sums of bits.  Tasks add the words up by carry-save adders: full adders turn three words of a weight
into one of the same and one of twice the weight, in numpy over whole columns of words; only what is left of each
weight is read bit by bit.  A word that stands for n documents enters the weights of the bits of n.

Filters A to D are functions of a text; E (the text of a smaller doc_id) is found on digests of whole texts.  Rows of one
digest, part and label are counted before digests meet, so a text that a third of all rows share is one row a task.

Defined results: a null text is empty; a null lang is the part ''.  A null doc_id is never smaller or larger than
another, has no label, and its rows neither fail E nor make others fail.  Rows that repeat a doc_id with the same text
don't fail E because of each other.  Of several labels of a doc_id any 1 counts; other values and nulls don't.
No documents: no rows.  Other columns of the tables are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored

FILTERS = "ABCDE"
COPY = 16  # the bit of filter E
ALL = 31
SUBSETS = np.arange(32, dtype=np.int64)
WORDS = np.array([sum(1 << s for s in range(32) if not s & m) for m in range(32)], np.uint32)
"""By the mask of the filters that a document fails: the subsets that it survives."""

UPPER = bytes(range(65, 91))
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes inside of a code point
MARKS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 200, 50, 3
MOST_KEYS = 4096


def failed(raw: bytes) -> int:
    """Mask of the filters A to D that a text (UTF-8) fails."""
    words = raw.split()  # bytes split at blanks, tabs and line ends of ASCII only
    upper, points = len(raw) - len(raw.translate(None, UPPER)), len(raw.translate(None, FOLLOWING))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
            | (100 * upper > MOST_UPPER_PERCENT * points) << 2 | any(mark in raw for mark in MARKS) << 3)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [raw or b"" for raw in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([failed(raw) for raw in texts], pa.int32()),
            pa.array([hashlib.blake2b(raw, digest_size=16).digest() for raw in texts], pa.binary())],
            names=["doc_id", "part", "mask", "digest"])


def add_words(planes: list[np.ndarray], words: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """Planes (words of weight 1, 2, 4, ...) with `words` added `times` often, each plane of two words at most."""
    planes = list(planes)

    def put(weight: int, more: np.ndarray) -> None:
        while len(planes) <= weight:
            planes.append(np.empty(0, np.uint32))
        planes[weight] = np.concatenate([planes[weight], more])

    for weight in range(int(times.max(initial=0)).bit_length()):
        put(weight, words[(times >> weight) & 1 == 1])
    weight = 0
    while weight < len(planes):
        while (third := len(planes[weight]) // 3) > 0:
            a, b, c = planes[weight][: 3 * third].reshape(3, third)
            half = a ^ b
            planes[weight] = np.concatenate([half ^ c, planes[weight][3 * third :]])
            put(weight + 1, (a & b) | (half & c))
        weight += 1
    return planes


def bit_counts(planes: list[np.ndarray]) -> list[int]:
    """How often each of the 32 bits was added."""
    return [sum(sum(int(word) >> bit & 1 for word in plane) << weight for weight, plane in enumerate(planes)) for bit in range(32)]


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset by part and label, added up for a task."""
    held: dict[tuple, list[np.ndarray]] = {}

    def given() -> pa.RecordBatch:
        keys = list(zip(*held)) or [[], [], []]
        kinds = [pa.string(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k, kind) for k, kind in zip(keys, kinds)), pa.array([bit_counts(p) for p in held.values()], pa.list_(pa.int64()))],
            names=["part", "good", "toxic", "survivors"])

    for batch in batches:
        rows = batch.to_pandas()
        for key, group in rows.groupby(["part", "good", "toxic"], sort=False):
            held[key] = add_words(held.get(key, []), WORDS[group["mask"].to_numpy()], group["n"].to_numpy())
        if len(held) > MOST_KEYS:
            yield given()
            held.clear()
    if held:
        yield given()


def _masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents of each part and label fail which filters: part, good, toxic, mask, n."""
    judged = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("raw")).mapInArrow(
        _judged, "doc_id bigint, part string, mask int, digest binary")
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("spread", F.lit(0))
    # rows without an id find no label; they are dealt by their digests
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("int") + 1).otherwise(0)
    labelled = judged.withColumn("spread", spread).join(label, ["doc_id", "spread"], "left").select(
        "doc_id", "part", "mask", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    same = ["digest", "part", "good", "toxic", "mask"]
    ids = labelled.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unknown = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    texts = stored(ids.groupBy(*same).agg(F.sum("n").alias("n"), unknown.alias("unknown"), first.alias("first")).select(
        *same, "n", "unknown", F.col("first.doc_id").alias("first_id"), F.coalesce("first.n", F.lit(0)).alias("first_n")))
    least = texts.groupBy("digest").agg(F.min("first_id").alias("least"))
    stays = F.col("unknown") + F.when(F.col("first_id") == F.col("least"), F.col("first_n")).otherwise(0)
    rows = texts.join(least, "digest").select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", stays.alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - stays).alias("n")))).alias("one"))
    return rows.select("part", "good", "toxic", "one.*").where("n > 0")


def _steps() -> tuple[str, str]:
    """Every step of every order as JSON, with its type: the subsets before and after it, and the weights whose sum is its shapley."""
    weights = {}
    for i in range(5):
        w = [0] * 32
        for subset in range(32):
            if not subset >> i & 1:
                often = factorial(subset.bit_count()) * factorial(4 - subset.bit_count())
                w[subset] += often
                w[subset | 1 << i] -= often
        weights[i] = w
    steps = []
    for order in permutations(range(5)):
        before = 0
        for step, i in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step + 1, "own": 1 << i, "before": before,
                          "after": before | 1 << i, "weights": weights[i]})
            before |= 1 << i
    return json.dumps(steps), ("array<struct<filter_order: string, step: int, own: int, before: int, after: int, weights: array<bigint>>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    counted = _masks(docs, labels).mapInArrow(_survivors, "part string, good boolean, toxic boolean, survivors array<bigint>")
    sums = counted.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "n")).groupBy("part", "subset").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"))
    by_subset = F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic")))
    parts = sums.groupBy("part").agg(by_subset.alias("left"))
    steps, kind = _steps()
    rows = parts.withColumn("s", F.explode(F.from_json(F.lit(steps), kind)))

    def left(subset, what="n"):
        return F.expr(f"left[{subset}].{what}")

    removed = left("s.before") - left("s.after")
    return rows.select(
        "part", "s.filter_order", "s.step", left("s.after").alias("kept"), removed.alias("removed"),
        (left("0") - left("s.own") - removed).alias("redundant"), (left(f"{ALL} - s.own") - left(f"{ALL}")).alias("unique_fails"),
        (left("s.before", "good") - left("s.after", "good")).alias("good_lost"),
        (left("s.before", "toxic") - left("s.after", "toxic")).alias("toxic_lost"),
        F.expr("aggregate(zip_with(left, s.weights, (l, w) -> l.n * w), 0L, (a, b) -> a + b)").alias("shapley"))


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
    FROM d JOIN c USING (text) LEFT JOIN l USING (doc_id)),
t AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit AND b.bit <> c.bit AND b.bit <> d.bit
    AND b.bit <> e.bit AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(k)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (before | own) = 0) AS kept,
    sum(n) FILTER (mask & before = 0 AND mask & own > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & own > 0) AS redundant,
    sum(n) FILTER (mask = own) AS unique_fails, sum(t.good) FILTER (mask & before = 0 AND mask & own > 0) AS good_lost,
    sum(t.toxic) FILTER (mask & before = 0 AND mask & own > 0) AS toxic_lost FROM t, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r"""
