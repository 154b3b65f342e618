"""Language identification: multinomial naive Bayes over hashed character n-grams.

`train` counts n-grams of every labelled text in the tasks, one vector of counts a language, and adds the vectors
up by pieces in a shuffle, so what reaches the driver is languages x buckets counts whatever the corpus.
`predict` carries the log-probability matrix to the tasks and scores batches: a gather and one sum a text.

Defined cases: a text that is null or has no letter is `und` with score 0 and teaches nothing; a null language
teaches nothing; without any labelled text every text is `und`; equal scores go to the language that comes first in
sorted order; repeated rows count each; texts are used whole, of any length. Only the named columns are read, others
pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from roadweave.llm.common import blocks, code_points, gram_buckets, range_sums, with_results

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
PIECES = 64


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    smoothing: float = 0.5
    evidence: int = 64
    """A score is the posterior as if the text had at most this many n-grams; long texts would all score 1."""


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, float32
    prior: np.ndarray
    settings: Settings


def _grams(texts: list[str], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets by position, and the range of positions of each text."""
    points, starts, ends = code_points([t.lower() for t in texts])
    for n in settings.orders:
        yield gram_buckets(points, n, settings.bits), starts, np.maximum(starts, ends - n + 1)


def _inside(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    full = ends > starts
    np.add.at(edge, starts[full], 1)
    np.add.at(edge, ends[full], -1)
    return np.cumsum(edge[:-1]) > 0


def train(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Count n-grams over all rows of `docs` with a language."""
    size = 1 << settings.bits
    width = size // PIECES

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for frame in frames:
            for language, part in frame.groupby("lang"):
                kept = [t for t in part["text"] if LETTER.search(t)]
                if not kept:
                    continue
                own = counts.setdefault(language, np.zeros(size, np.int64))
                texts[language] = texts.get(language, 0) + len(kept)
                for first, last in blocks(kept):
                    for buckets, starts, ends in _grams(kept[first:last], settings):
                        own += np.bincount(buckets[_inside(len(buckets), starts, ends)], minlength=size)
        for language, own in counts.items():
            yield pd.DataFrame({"lang": language, "piece": np.arange(PIECES), "texts": texts[language],
                                "counts": list(own.reshape(PIECES, width))})

    def total(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, texts = np.zeros(width, np.int64), 0
        for frame in frames:
            for own in frame["counts"]:
                counts += own
            texts += int(frame["texts"].sum())
        yield pd.DataFrame({"lang": [key[0]], "piece": [key[1]], "texts": [texts], "counts": [counts]})

    schema = "lang string, piece int, texts long, counts array<long>"
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = labelled.mapInPandas(count, schema).groupBy("lang", "piece").applyInPandas(total, schema).toPandas()
    languages = sorted(rows["lang"].unique())
    counts, texts = np.zeros((size, len(languages))), np.zeros(len(languages))
    for language, piece, number, own in rows.itertuples(index=False):
        at = languages.index(language)
        counts[piece * width : (piece + 1) * width, at] = own
        texts[at] = number
    smoothed = counts + settings.smoothing
    log_prob = np.log(smoothed / smoothed.sum(axis=0, keepdims=True)).astype(np.float32)
    prior = np.log(texts / texts.sum()) if len(languages) else np.zeros(0)
    return Model(languages, log_prob, prior, settings)


def scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Best language (an index, -1 for none) and its tempered posterior for each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not model.languages or not known:
        return best, score
    for first, last in blocks([texts[i] for i in known]):
        own = known[first:last]
        sums, number = np.zeros((len(own), len(model.languages))), np.zeros(len(own))
        for buckets, starts, ends in _grams([texts[i] for i in own], model.settings):
            number += ends - starts
            for k in range(len(model.languages)):
                sums[:, k] += range_sums(model.log_prob[:, k][buckets].astype(np.float64), starts, ends)
        exact = sums + model.prior
        best[own] = exact.argmax(axis=1)
        tempered = sums * (np.minimum(number, model.settings.evidence) / np.maximum(number, 1))[:, None] + model.prior
        tempered = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        score[own] = (tempered / tempered.sum(axis=1, keepdims=True))[np.arange(len(own)), best[own]]
    return best, score


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs`, the predicted language and its score."""
    model = Model(model.languages, np.asfortranarray(model.log_prob), model.prior, model.settings)
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def work(texts: list[str | None]) -> list:
        best, value = scores([t or "" for t in texts], model)
        return [names[best], value]

    return with_results(docs, [text], [StructField(lang_pred, StringType()), StructField(score, DoubleType())], work)
