"""Toxicity: cumulative-link ordinal regression on sparse character n-grams.

P(grade > j) = sigmoid(w . x - cut_j): one weight vector, shared by all ordered cuts. x holds log2(1 + occurrences)
of the chosen hashed character n-grams. The result is the expected grade, the sum of P(grade > j) over the cuts.

The model is fitted on a bounded sample of labelled rows (`Settings.sample_rows`, texts of at most
`Settings.sample_chars`, chosen by a hash of the id, so the same rows at every partitioning); scoring reads whole
texts of all rows in the tasks. Where labels are yes or no, `graded` makes grades: 0 for no; the yes rows are split
into thirds, 1 to 3, by how many distinct n-grams typical of yes rows they hold.

Defined cases: a null text counts as empty; an empty text holds no n-gram and gets the grade of the cuts alone;
labels or ids that are null teach nothing; repeated rows count each; without labels of both kinds nothing is toxic
and every severity is 0; only the named columns are read, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField

from roadweave.llm.common import blocks, code_points, gram_buckets, with_results


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 22
    features: int = 1024
    least_texts: int = 4
    least_log_odds: float = 2.5
    grades: int = 4
    flag_at: float = 0.2
    """A text counts as toxic from this P(grade > 0) on; to miss one is worse than to lose a clean one."""
    sample_rows: int = 6_000
    sample_chars: int = 50_000
    steps: int = 400
    rate: float = 0.2
    shrink: float = 1e-5


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    settings: Settings


def _held(texts: list[str], settings: Settings, wanted: np.ndarray | None):
    """(text, bucket) of every n-gram whose bucket is wanted, repeats included, block by block."""
    for first, last in blocks(texts, 500_000):
        points, starts, ends = code_points([t.lower() for t in texts[first:last]])
        for n in settings.orders:
            buckets = gram_buckets(points, n, settings.bits)
            at = np.flatnonzero(wanted[buckets]) if wanted is not None else np.arange(len(buckets))
            rows = np.searchsorted(starts, at, "right") - 1
            inside = at + n <= ends[rows]
            yield rows[inside] + first, buckets[at[inside]]


def sample(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled texts. The ids are chosen first, so only their texts move."""
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows))
    rows = (docs.where(F.length("text") <= settings.sample_chars).select("doc_id", "text")
            .join(F.broadcast(ids), "doc_id")  # at most sample_rows ids
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(settings.sample_rows)
            .select("text", F.col("label").cast("long")).toArrow())
    return rows["text"].to_pylist(), rows["label"].to_numpy().astype(np.int64)


def choose(texts: list[str], positive: np.ndarray, settings: Settings) -> np.ndarray:
    """Buckets typical of the positive texts, by how many texts of either kind hold them."""
    often = np.zeros((2, 1 << settings.bits), np.int32)
    for rows, buckets in _held(texts, settings, None):
        for kind in (0, 1):
            own, times = np.unique(np.sort(buckets[positive[rows] == kind]), return_counts=True)
            often[kind, own] += times.astype(np.int32)
    held = np.flatnonzero(often[1] >= settings.least_texts)
    no_rate, yes_rate = ((often[kind, held] + 0.5) / (often[kind].sum() + 1) for kind in (0, 1))
    likely = held[yes_rate > 2 * no_rate]
    rows, columns, _ = _columns(texts, likely, settings)
    yes = np.bincount(columns[positive[rows]], minlength=len(likely))
    no = np.bincount(columns[~positive[rows]], minlength=len(likely))
    all_yes, all_no = max(positive.sum(), 1), max((~positive).sum(), 1)
    odds = np.log((yes + 0.5) / (all_yes + 1)) - np.log((no + 0.5) / (all_no + 1))
    kept = np.flatnonzero((yes >= settings.least_texts) & (odds >= settings.least_log_odds))
    expected = (yes + no)[kept] * all_yes / (all_yes + all_no)
    gain = (yes[kept] - expected) ** 2 / expected
    return np.sort(likely[kept[np.argsort(-gain, kind="stable")[: settings.features]]])


def _columns(texts: list[str], buckets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs and their values: log2(1 + occurrences)."""
    wanted = np.zeros(1 << settings.bits, bool)
    wanted[buckets] = True
    width = max(len(buckets), 1)
    pairs = [r * width + np.searchsorted(buckets, b) for r, b in _held(texts, settings, wanted)]
    pairs = np.sort(np.concatenate([*pairs, np.empty(0, np.int64)]))
    at = np.flatnonzero(np.diff(pairs, prepend=-1) > 0)
    times = np.diff(at, append=len(pairs))
    return pairs[at] // width, pairs[at] % width, np.log2(1 + times)


def graded(texts: list[str], positive: np.ndarray, buckets: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Grades from yes/no labels: yes rows in equal parts by how many of the typical `buckets` they hold."""
    rows, _, _ = _columns(texts, buckets, settings)
    held = np.bincount(rows, minlength=len(texts))
    levels = settings.grades - 1
    order = np.argsort(np.argsort(held[positive], kind="stable"), kind="stable")
    grades = np.zeros(len(texts), np.int64)
    grades[positive] = 1 + order * levels // max(positive.sum(), 1)
    return grades


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(texts: list[str], grades: np.ndarray, buckets: np.ndarray, settings: Settings = Settings()) -> Model:
    """Maximum likelihood with a small ridge, by Adam over the whole sample."""
    if len(set((grades > 0).tolist())) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), np.full(settings.grades - 1, np.inf), settings)
    rows, columns, values = _columns(texts, buckets, settings)
    number, levels = len(texts), settings.grades - 1
    shares = np.array([np.clip((grades > j).mean(), 1e-4, 1 - 1e-4) for j in range(levels)])
    cuts = np.maximum.accumulate(-np.log(shares / (1 - shares)) + 1e-3 * np.arange(levels))
    # parameters: weights, the first cut, logarithms of the steps between cuts
    x = np.concatenate([np.zeros(len(buckets)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    mean, power = np.zeros_like(x), np.zeros_like(x)
    low = np.arange(number), np.maximum(grades - 1, 0)
    high = np.arange(number), np.minimum(grades, levels - 1)
    for step in range(1, settings.steps + 1):
        weights, gaps = x[: len(buckets)], np.exp(x[len(buckets) + 1 :])
        cuts = x[len(buckets)] + np.concatenate([[0.0], np.cumsum(gaps)])
        above = _sigmoid(np.bincount(rows, values * weights[columns], number)[:, None] - cuts)
        a = np.where(grades > 0, above[low], 1.0)
        b = np.where(grades < levels, above[high], 0.0)
        chance = np.maximum(a - b, 1e-12)
        by_text = a + b - 1
        by_cut = np.zeros((number, levels))
        np.add.at(by_cut, low, np.where(grades > 0, a * (1 - a) / chance, 0))
        np.add.at(by_cut, high, np.where(grades < levels, -b * (1 - b) / chance, 0))
        slope_cuts = by_cut.mean(axis=0)
        slope = np.concatenate([
            np.bincount(columns, values * by_text[rows], len(buckets)) / number + settings.shrink * weights,
            [slope_cuts.sum()], np.cumsum(slope_cuts[::-1])[::-1][1:] * gaps])
        mean, power = 0.9 * mean + 0.1 * slope, 0.999 * power + 0.001 * slope**2
        x -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(x[len(buckets) + 1 :])
    return Model(buckets, x[: len(buckets)], x[len(buckets)] + np.concatenate([[0.0], np.cumsum(gaps)]), settings)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Sample, grade and fit, for labels that are 0 or 1."""
    texts, values = sample(docs, labels, label, settings)
    buckets = choose(texts, values > 0, settings)
    return fit(texts, graded(texts, values > 0, buckets, settings), buckets, settings)


def chances(texts: list[str], model: Model) -> np.ndarray:
    """P(grade > j) for each text and cut."""
    rows, columns, values = _columns(texts, model.buckets, model.settings)
    return _sigmoid(np.bincount(rows, values * model.weights[columns], len(texts))[:, None] - model.cuts)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, `severity` (expected grade), `grade` (the median one, 1 at least if toxic) and `toxic`."""

    def work(texts: list[str | None]) -> list:
        above = chances([t or "" for t in texts], model)
        toxic = above[:, 0] >= model.settings.flag_at
        return [above.sum(axis=1), (toxic + (above[:, 1:] >= 0.5).sum(axis=1)).astype(np.int32), toxic]

    added = [StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic", BooleanType())]
    return with_results(docs, [text], added, work)
