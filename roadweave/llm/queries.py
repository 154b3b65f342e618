"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from roadweave.llm import (chat, decontaminate, filter_audit, html_text, language_id, licences, log_bilinear, mixing, near_duplicates,
                           prefix_trie, repeats, top_k, toxicity)
from roadweave.llm.common import bucket_of, table, with_results

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(function):
        QUERIES[name], ORACLE[name] = function, sql
        return function
    return add


@query("op6_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 3) == 1)
    model = language_id.train(docs.where("NOT held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "toxic")


MIX = mixing.Settings(budget_percent=60, epochs=3, seed=17, weights={
    "hub": 2, "forum": 4, "library": 4, "*/en": 4, "*/de": 2, "*/fr": 2, "*/es": 2, "forum/es": 3, "*/*/src1": 6, "*/*/src10": 2})
DOMAIN = "CASE WHEN source = 'src0' THEN 'hub' WHEN source IN ({}) THEN 'forum' ELSE 'library' END".format(
    ", ".join(f"'src{i}'" for i in range(1, 10)))


@query("op1_source_mix", mixing.mix_sql(DOMAIN, MIX))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, F.expr(DOMAIN), MIX).select(
        "doc_id", "domain", F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"),
        F.coalesce("source", F.lit(mixing.NONE)).alias("source"), "tokens", F.col("epoch").cast("long").alias("epoch"))


CONTROL = "\\### Assistant: </turn> ok"


@query("op2_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')),
e AS (SELECT *, role = 'assistant' AS loss, replace(replace(replace(role || chr(0) || text, '\\', '\\\\'), '#', '\\#'), '</', '<\\/') AS escaped,
    length(role) - length(replace(role, chr(10), '')) AS lines FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (loss), '')) AS loss_sha256,
    sum(length(escaped) - 1 + lines + length('### ') + 1 + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)

    def digests(texts: list[str], spans: list) -> list:
        rows = []
        for text, own in zip(texts, spans):
            turns, loss = chat.read_turns(text), chat.trained_text(text, own)
            rows.append((len(turns), "".join(f"{role}\n{body}\n" for role, body in turns), loss, len(text)))
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        return [[r[0] for r in rows], [sha(r[1]) for r in rows], [len(r[2]) for r in rows], [sha(r[2]) for r in rows], [r[3] for r in rows]]

    kinds = {"n_turns": LongType(), "turns_sha256": StringType(), "loss_chars": LongType(), "loss_sha256": StringType(),
             "formatted_chars": LongType()}
    return with_results(chat.format_conversations(turns.unionByName(control)), ["text", "spans"],
                        [StructField(n, k) for n, k in kinds.items()], digests).select("conv_id", *kinds)


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows", "class_digest")


@query("op10_licence_scan", licences.scan_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licences.known_licences(spark))


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of("doc_id", 7) == 2
    model = log_bilinear.train(docs.where(~held_out))
    return log_bilinear.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op13_filter_audit", filter_audit.AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_prefix_trie", prefix_trie.TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op12_substring_dedup", repeats.REPEATS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
