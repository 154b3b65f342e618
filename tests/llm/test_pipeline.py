"""The whole pipeline against a plain version: loops over all documents, all pairs, all items, and SQL for the mix."""

from itertools import combinations

import duckdb
import numpy as np

import corpus_pipeline
from roadweave.llm import decontaminate, language_id, mixing, near_duplicates, toxicity
from roadweave.llm.common import bucket_of, corpus_session
from roadweave.llm.queries import DOMAIN, MIX
from tests.llm.test_matching import plain_similarity

PATH = "/root/testdata/sf0.001"


def near_classes(texts, idf):
    """Least id of each class of ids whose texts are equal or similar, directly or through others."""
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if texts[a] == texts[b] or plain_similarity(texts[a], texts[b], idf) >= 0.8:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {find(i) for i in texts}


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    docs = corpus_session(spark).read.parquet(f"{PATH}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = language_id.train(docs.where(bucket_of("doc_id", 3) != 1))
    best, score = language_id.scores(list(rows.values()), model)
    kept = [i for i, b, s in zip(rows, best, score) if b >= 0 and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]

    judge = toxicity.train(docs.where(docs.doc_id.isin(kept)), spark.read.parquet(f"{PATH}/labels.parquet"))
    chance = toxicity.chances([rows[i] for i in kept], judge)[:, 0]
    kept = [i for i, c in zip(kept, chance) if c < judge.settings.flag_at]

    idf = near_duplicates.document_frequencies(docs.where(docs.doc_id.isin(kept)))
    kept = sorted(near_classes({i: rows[i] for i in kept}, idf))

    items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    patterns = [decontaminate.Pattern(0, t, int(len(t) * decontaminate.Settings().error_rate)) for t in items if t]
    leaked = [i for i in kept if any(p.nearest(decontaminate.plain(rows[i]))[0] <= p.errors for p in patterns)]
    kept = [i for i in kept if i not in leaked]

    docs.where(docs.doc_id.isin(kept)).toPandas().to_parquet(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    wanted = db.execute(f"select doc_id, domain, tokens, epoch from ({mixing.mix_sql(DOMAIN, MIX)})").fetchall()

    found = corpus_pipeline.run(spark, PATH).select("doc_id", "domain", "tokens", "epoch").collect()
    assert sorted(tuple(r) for r in found) == sorted(wanted)
    assert leaked and np.all(chance >= 0) and len(kept) < len(rows)
