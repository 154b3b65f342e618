"""Corpus pipeline: five stages, each over all that its predecessor kept.

Every stage reads the columns of `documents` alone (others are dropped, whatever their names), takes texts of any length
whole, treats repeated rows each by itself but for the near-duplicate stage, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import decontaminate, language_id, mixing, near_duplicates, toxicity
from roadweave.llm.common import bucket_of, corpus_session, stored
from roadweave.llm.queries import DOMAIN, MIX

ORACLE_SQL = None
"""The stages hold trained models and hash sampling, which SQL can't express; tests/llm compares them with brute force."""

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no letter (null and empty texts too), or a score below LEAST_LANGUAGE_SCORE.

    Documents with a null id count as held in for training; with no labelled text nothing is recognised and all go.
    """
    docs = corpus_session(spark) and docs.select(*COLUMNS)
    model = language_id.train(docs.where(bucket_of("doc_id", 3) != 1))
    return language_id.predict(docs, model, "text", "__lang", "__score").where(
        f"__lang <> '{language_id.UNKNOWN}' AND __score >= {LEAST_LANGUAGE_SCORE}").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are toxic by the model; null texts count as empty, and without labels of both kinds all stay."""
    model = toxicity.train(docs, corpus_session(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("NOT toxic").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each class of near-duplicates; ties end in the digest, then the other columns.

    Documents with a null text stay; rows that are equal in all columns are copies.
    """
    return near_duplicates.one_of_each(corpus_session(spark) and docs.select(*COLUMNS))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with some edits; null and empty texts hold none, null items match none."""
    items = corpus_session(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs.select(*COLUMNS), items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every epoch that its source's budget gives it; also domain, tokens and epoch."""
    return mixing.mix(corpus_session(spark) and docs.select(*COLUMNS), F.expr(DOMAIN), MIX)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass all stages; each stage's rows are written once and read by the next."""
    docs = corpus_session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
