"""Language-model scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation (NCE).

Tokens are words (runs of bytes other than ASCII white space, A-Z in lower case) and an end after each text. Every
token has a class: each of the `head` most frequent words is one, the end is one, and all other words share `buckets`
classes by their last three bytes. The network scores class w after class a as R[a] C Q[w] + b[w]; a word of a bucket
then gets its smoothed share of the bucket, (count + 1) / (tokens + words + 1). So the probabilities of all known words,
one unknown word a bucket, and the end add up to 1.

Three passes over the training texts' tokens, all of them: word counts (a shuffle, as large as the vocabulary), class
pairs (at most classes x classes counts, summed in a shuffle), and the scoring. NCE runs on the driver over the matrix of
class pairs with the noise's expectation worked out, so it sees every training token and draws nothing by chance.
Scoring multiplies the distinct contexts of a batch with all classes, normalises, and picks each token's value. Counts
of words beyond the `dictionary` most frequent are joined, a row for each text and word; no vocabulary is ever
held whole.

Defined cases: null texts count as empty: one end; repeated rows count each; without training texts all words are
unknown and the network is as it started; a text is scored whole; null ids are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from roadweave.llm.common import stored

END = b"\n"
"""Never a word, as white space parts words."""


@dataclass(frozen=True)
class Settings:
    head: int = 895
    buckets: int = 128
    dictionary: int = 200_000
    size: int = 48
    noise: int = 16
    steps: int = 250
    prior: float = 100
    """Pseudo-tokens that each context has seen, spread by frequency: rare contexts stay near the overall chances."""
    rate: float = 0.03
    held_words: int = 300_000
    """Distinct words a task counts before it hands them on."""


@dataclass(frozen=True)
class Model:
    counts: DataFrame  # token, c: stored
    words: list[bytes]  # the dictionary, END first, then the head
    word_counts: np.ndarray
    head: int
    tokens: int
    vocabulary: int
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    network: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    settings: Settings


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-3:]) % buckets


def count_words(texts: DataFrame, settings: Settings) -> DataFrame:
    """(token, c) over all rows of `texts`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def record() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                              names=["token", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in tokens_of(text):
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) > settings.held_words:
                    yield record()
        if counts:
            yield record()

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


class _Classes:
    """Words to places in the dictionary and to classes."""

    def __init__(self, words: list[bytes], head: int, buckets: int):
        self.at = {word: i for i, word in enumerate(words)}
        self.head, self.buckets = head, buckets
        self.first_bucket = head + 1
        self.number = head + 1 + buckets
        # the dictionary begins with the end and the head, which are classes of their own
        self.of = np.array([i if i <= head else self.first_bucket + _bucket(w, buckets) for i, w in enumerate(words)], np.int32)

    def read(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """All tokens; each one's place in the dictionary or -1, its class, and the number of tokens of each text."""
        words: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = tokens_of(text)
            sizes[i] = len(own)
            words += own
        places = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        classes = self.of[places]
        for i in np.flatnonzero(places < 0).tolist():
            classes[i] = self.first_bucket + _bucket(words[i], self.buckets)
        return words, places, classes, sizes


def _before(classes: np.ndarray) -> np.ndarray:
    """Class before each token; the first of a text follows an end."""
    return np.concatenate([np.zeros(1, classes.dtype), classes[:-1]])


def count_pairs(texts: DataFrame, words: list[bytes], head: int, settings: Settings) -> np.ndarray:
    """Matrix of how often class w follows class a."""
    number = head + 1 + settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, counts = _Classes(words, head, settings.buckets), np.zeros(number * number, np.int64)
        for batch in batches:
            _, _, own, _ = classes.read(batch.column(0).to_pylist())
            counts += np.bincount(_before(own).astype(np.int64) * number + own, minlength=len(counts))
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts[pair])], names=["pair", "n"])

    rows = texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(number * number)
    counts[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return counts.reshape(number, number)


def fit(pairs: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """R, C, Q and b by NCE: tell each observed pair from `noise` ones drawn by frequency, in expectation; Adam."""
    number, random = len(pairs), np.random.default_rng(0)
    frequency = (pairs.sum(axis=0) + 1) / (pairs.sum() + number)
    pairs = pairs + settings.prior * frequency
    seen = (pairs / pairs.sum()).astype(np.float32)
    noise = (seen.sum(axis=1, keepdims=True) * settings.noise * frequency).astype(np.float32)
    offset = np.log(settings.noise * frequency).astype(np.float32)
    scale = 1 / np.sqrt(settings.size)
    network = [random.normal(0, scale, (number, settings.size)).astype(np.float32), np.eye(settings.size, dtype=np.float32),
               random.normal(0, 0.1 * scale, (number, settings.size)).astype(np.float32), np.log(frequency).astype(np.float32)]
    mean, power = [np.zeros_like(x) for x in network], [np.zeros_like(x) for x in network]
    for step in range(1, settings.steps + 1):
        R, C, Q, b = network
        H = R @ C
        chance = 1 / (1 + np.exp(np.minimum(offset - (H @ Q.T + b), 60)))
        slope = (seen + noise) * chance - seen
        to_H = slope @ Q
        slopes = [to_H @ C.T, R.T @ to_H, slope.T @ H, slope.sum(axis=0)]
        for i, g in enumerate(slopes):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            power[i] = 0.99 * power[i] + 0.01 * g * g
            network[i] = network[i] - settings.rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.99**step)) + 1e-9)
    return tuple(network)


def class_log_probabilities(contexts: np.ndarray, network: tuple) -> np.ndarray:
    """log10 P(class | context), a row for each context: one matrix product, normalised."""
    R, C, Q, b = network
    scores = (R[contexts] @ C) @ Q.T + b
    most = scores.max(axis=1, keepdims=True)
    return (scores - most - np.log(np.exp(scores - most).sum(axis=1, keepdims=True))) / np.float32(np.log(10))


def train(texts: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from all rows of `texts` (column text)."""
    counts = stored(count_words(texts, settings))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the dictionary: words of at least a count that few enough reach, found on steps of the count's logarithm
    step = F.floor(F.log2("c") * 64)
    steps = counts.where(F.col("token") != END).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for row in steps:
        held += row["n"]
        if held > settings.dictionary:
            break
        least = row["step"]
    frequent = [] if least is None else counts.where((step >= least) & (F.col("token") != END)).collect()
    frequent = sorted(((-r["c"], bytes(r["token"])) for r in frequent))
    ends = counts.where(F.col("token") == END).first()
    words = [END, *[w for _, w in frequent]]
    word_counts = np.array([ends["c"] if ends else 0, *[-c for c, _ in frequent]], np.int64)
    head = min(settings.head, len(frequent))
    pairs = count_pairs(texts, words, head, settings)
    spark = texts.sparkSession
    heads = spark.createDataFrame([(w,) for w in words[: head + 1]], "token binary")
    tail = counts.join(F.broadcast(heads), "token", "left_anti")
    last = F.expr("substring(token, greatest(length(token) - 2, 1), 3)")
    rows = tail.groupBy(F.pmod(F.crc32(last), F.lit(settings.buckets)).alias("bucket")).agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect()
    bucket_tokens, bucket_words = np.zeros(settings.buckets), np.zeros(settings.buckets)
    for row in rows:
        bucket_tokens[row["bucket"]], bucket_words[row["bucket"]] = row["t"], row["v"]
    return Model(counts, words, word_counts, head, int(total[0]), int(total[1]), bucket_tokens, bucket_words, fit(pairs, settings), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text)."""
    words, head, buckets, network = model.words, model.head, model.settings.buckets, model.network
    logs = np.log10(model.word_counts + 1.0)
    bucket_logs = np.log10(model.bucket_tokens + model.bucket_words + 1)
    id_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    pair = pa.struct([("token", pa.binary()), ("n", pa.int64())])
    names = ["row", "doc_id", "n_tokens", "n_known", "log_counts", "log_model", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, row = _Classes(words, head, buckets), TaskContext.get().partitionId() << 33
        for batch in batches:
            tokens, places, own, sizes = classes.read(batch.column(1).to_pylist())
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            contexts, context_of = np.unique(_before(own), return_inverse=True)
            by_class = class_log_probabilities(contexts, network)
            known, known_log = places >= 0, logs[places]
            shared = own > head  # tokens that are one of a bucket
            value = by_class[context_of, own].astype(np.float64)
            value[shared] += np.where(known[shared], known_log[shared], 0) - bucket_logs[own[shared] - head - 1]
            total = lambda x: np.bincount(text_of, x, len(sizes))
            tail: dict[tuple[int, bytes], int] = {}
            rare = np.flatnonzero(~known)
            for text, i in zip(text_of[rare].tolist(), rare.tolist()):
                key = text, tokens[i]
                tail[key] = tail.get(key, 0) + 1
            found = np.bincount(np.fromiter((t for t, _ in tail), np.int64, len(tail)), minlength=len(sizes))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array([w for _, w in tail], pa.binary()), pa.array(tail.values(), pa.int64())], fields=list(pair)))
            seen = known & (model_counts[places] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sizes))), batch.column(0).cast(id_kind), pa.array(sizes), pa.array(total(seen).astype(np.int64)),
                 pa.array(total(np.where(known, known_log, 0))), pa.array(total(value)), lists], names=names)
            row += len(sizes)

    model_counts = model.word_counts
    schema = (f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, log_counts double, "
              "log_model double, tail array<struct<token: binary, n: bigint>>")
    partial = stored(docs.select("doc_id", "text").mapInArrow(run, schema))
    tails = partial.select("row", F.inline("tail")).join(model.counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_log"))
    space = float(np.log10(model.tokens + model.vocabulary + 1))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return partial.drop("tail").join(tails, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + tail_log - F.col("n_tokens") * space).alias("base_score"), (F.col("log_model") + tail_log).alias("score"))
