"""Decontamination, near-duplicates, licences and exact search against plain Python or SQL."""

import pathlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadweave.llm import decontaminate, licences, near_duplicates, top_k
from roadweave.llm.common import corpus_session


def least_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(before[j + 1] + 1, now[j] + 1, before[j] + (a != b)))
        before = now
    return min(before)


def test_pieces_and_bit_parallel_distance_equal_a_plain_table():
    r = random.Random(1)
    for _ in range(400):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        edited = list(item)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(edited) + 1)
            if r.random() < 0.4:
                edited.insert(at, r.choice("abc"))
            elif at < len(edited):
                edited[at] = r.choice("abc")
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 30))) + "".join(edited) + "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        settings = decontaminate.Settings(error_rate=r.choice([0, 0.08, 0.15, 0.3]))
        least, most = least_distance(item, text), int(len(item) * settings.error_rate)
        found = decontaminate.Matcher([(1, item)], settings).matches(text)
        assert bool(found) == (least <= most) and (not found or found[0][1] == least)


def test_leaks_of_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    items = corpus_session(spark).createDataFrame([(1, item), (2, None), (3, ""), (4, item.upper()), (None, "some other question that nobody asked")],
                                                  "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"x {item} y", 0), (2, "x " + item.replace("quick", "quack").replace(" ", "\n"), 0), (3, None, 0), (4, "", 0),
         (5, "the quick brown cat sleeps under the lazy tree near the hill", 0), (6, "filler " * 30000 + item + " end" * 10000, 0),
         (None, item, 0), (1, f"x {item} y", 0), (7, "Some other  question that nobody asked", 0)], "doc_id long, text string, distance int")
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_chars=70)):
        rows = sorted(((r["doc_id"] or 0, r["item_id"] or 0, r["distance"]) for r in decontaminate.matches(docs, items, settings).collect()))
        assert rows == [(0, 1, 0), (0, 4, 0), (1, 1, 0), (1, 1, 0), (1, 4, 0), (1, 4, 0), (2, 1, 1), (2, 4, 1), (6, 1, 0), (6, 4, 0), (7, 0, 0)]
        kept = decontaminate.without_leaks(docs, items, settings)
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.without_leaks(docs, items.limit(0)).count() == 9
    assert decontaminate.matches(docs.limit(0), items).count() == 0


def plain_similarity(a, b, idf, words=5):
    def weights(text):
        _, hashes, times = near_duplicates.shingles([text], words)
        return dict(zip(hashes.tolist(), near_duplicates._weights(hashes, times, idf).tolist()))
    x, y = weights(a), weights(b)
    common = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    whole = sum(x.values()) + sum(y.values()) - common
    return common / whole if whole else 0


def test_shingles_equal_plain_word_windows():
    texts = ["a b c d e f", "", "one", "one two", "A  b\tc d E f", "x " * 9, "é ü ñ ß ô"]
    owner, hashes, times = near_duplicates.shingles(texts, 5)
    by_text = [sorted(times[owner == i].tolist()) for i in range(len(texts))]
    assert by_text == [[1, 1], [], [1], [1], [1, 1], [5], [1]]
    assert hashes[owner == 0].tolist() == hashes[owner == 4].tolist()
    assert len(set(hashes.tolist())) == 2 + 1 + 1 + 1 + 1


def test_samples_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(4)
    hashes = np.sort(r.integers(0, 1 << 52, 300).astype(np.uint64))
    left, right = r.gamma(2, 1, 300).astype(np.float32), r.gamma(2, 1, 300).astype(np.float32)
    right[:150] = left[:150]
    a, b = (near_duplicates.samples(hashes, w, np.array([0]), 4000)[0] for w in (left, right))
    assert abs((a == b).mean() - np.minimum(left, right).sum() / np.maximum(left, right).sum()) < 0.03


def test_similarities_of_blocks_and_pairs_equal_plain_sets():
    r = random.Random(9)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 25))) for _ in range(30)] + ["", "a", "x x x x x x x x", "x x x x x x"]
    idf = np.random.default_rng(1).uniform(0.5, 5, 1 << 10).astype(np.float32)
    settings = near_duplicates.Settings()
    block = near_duplicates.similarities(texts[:20], texts[10:], idf, settings)
    for i, a in enumerate(texts[:20]):
        for j, b in enumerate(texts[10:]):
            assert block[i, j] == pytest.approx(plain_similarity(a, b, idf), abs=1e-6)
    pairs = near_duplicates.weighted_jaccard(texts[:-1], texts[1:], idf, settings)
    assert pairs == pytest.approx([plain_similarity(a, b, idf) for a, b in zip(texts, texts[1:])], abs=1e-6)


def test_components_equal_union_find(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {row["node"]: row["root"] for row in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_classes_equal_all_pairs(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(words(r.randint(1, 60))) for _ in range(60)]
    for size, edits in ((60, 3), (40, 1), (120, 4)):  # groups whose members are near the least similarity of each other
        base = words(size)
        for _ in range(45):
            copy = list(base)
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(size)] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += texts[:5] + ["", "", "a b", "A  B"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, None), (None, "only once here"), (None, None), (0, texts[0])]
    docs = corpus_session(spark).createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = near_duplicates.near_duplicates(docs)
    classes = {row["doc_id"]: row["class_id"] for row in found.where("doc_id IS NOT NULL").collect()}
    idf = near_duplicates.document_frequencies(docs)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, b in combinations(range(len(texts)), 2):
        if texts[a] == texts[b] or plain_similarity(texts[a], texts[b], idf) >= 0.8:
            links += 1
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert links > 300
    assert {i: classes[i] for i in range(len(texts))} == {i: find(i) for i in range(len(texts))}
    assert classes[900] == 900 and classes[901] == 901 and found.count() == len(rows)
    kept = near_duplicates.one_of_each(docs.withColumn("key", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "key"]
    ids = sorted((row["doc_id"] if row["doc_id"] is not None else -1) for row in kept.collect())
    assert ids == sorted([*{find(i) for i in range(len(texts))}, 900, 901, -1, -1])


def test_classes_with_null_or_repeated_ids_stay_apart(spark):
    r = random.Random(12)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    none, other, same, third = text(), text(), text(), text()
    near = third.rsplit(" ", 1)[0] + " end"
    rows = [(None, none), (None, other), (None, other), (7, same), (7, third), (9, near), (None, near), (7, None), (7, None), (None, None)]
    docs = corpus_session(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(row) for row in near_duplicates.one_of_each(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, none), (None, other), (7, same), (7, third), (7, None), (7, None), (None, None)]))
    found = near_duplicates.near_duplicates(docs).where("digest IS NOT NULL").groupBy("class_digest").agg(
        F.min("class_id"), F.max("class_id"), F.min("class_rows"), F.max("class_rows"), F.count("*")).drop("class_digest").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(None, None, 1, 1, 1), (None, None, 2, 2, 2), (7, 7, 1, 1, 1), (7, 7, 3, 3, 3)]))


def test_repeated_rows_are_one_text_of_their_node(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    near = [" ".join(words), " ".join([*words, "end"])]
    rows = [(n, text) for n, text in enumerate(near) for _ in range(300)] + [(None, near[0])] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    search = near_duplicates._Search(corpus_session(spark) and docs, near_duplicates.Settings())
    assert sorted(row["text"] for row in search.texts.collect()) == sorted(near)
    classes = near_duplicates.near_duplicates(docs).collect()
    assert len(classes) == len(rows) and {(row["class_id"], row["class_rows"]) for row in classes} == {(0, len(rows))}


def test_of_equal_ids_and_texts_the_least_other_columns_stay(spark):
    text = "the same words in every row of this small table of copies"
    rows = [(1, text, lang, {"k": source}, source) for lang in ("en", "de", None) for source in ("b", "a")] * 3 + [(2, text, "aa", None, "a")]
    schema = "doc_id long, text string, lang string, tags map<string,string>, `so.urce` string"
    for parts in (1, 3, 7):
        docs = corpus_session(spark) and spark.createDataFrame(rows, schema).repartition(parts)
        assert [tuple(row) for row in near_duplicates.one_of_each(docs).collect()] == [(1, text, None, {"k": "a"}, "a")]


def test_a_benchmark_of_several_blocks(spark):
    items = [(i, f"item number {i} asks for the capital of land {i * 7} and its river") for i in range(40)]
    docs = [(d, f"start {items[d % 40][1]} end" if d % 3 else "nothing of it") for d in range(60)]
    tables = [spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")]
    found = []
    for size in (10**6, 300):
        settings = decontaminate.Settings(error_rate=0.0, block_chars=size)
        kept = decontaminate.without_leaks(tables[1], tables[0], settings).collect()
        assert sorted(row["doc_id"] for row in kept) == [d for d, _ in docs if d % 3 == 0]
        found.append(sorted((row["doc_id"], row["item_id"]) for row in decontaminate.matches(tables[1], tables[0], settings).collect()))
    assert found == [[(d, d % 40) for d, _ in docs if d % 3]] * 2


def test_near_duplicates_of_an_empty_table(spark):
    empty = corpus_session(spark).createDataFrame([], "doc_id long, text string")
    assert near_duplicates.near_duplicates(empty).count() == 0 and near_duplicates.one_of_each(empty).count() == 0


def test_canonical_texts_and_scan_equal_sql(spark, tmp_path):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    docs = corpus_session(spark).createDataFrame(
        [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (2, "text\nReleased under the MIT Licence!\nreleased UNDER the mit license"),
         (3, None), (4, ""), (5, "© 1999 me"), (None, "Licensed under CC BY-NC 4.0"), (6, mit.replace("sublicense", "sub-license").replace("\n\n", "\n")),
         (7, "x " * 60000 + "\nAll rights reserved."), (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (8, mit + " And more.")],
        "doc_id long, text string")
    rows = licences.scan(docs, licences.known_licences(spark)).toPandas()
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select doc_id::bigint as doc_id, text from '{tmp_path}/documents.parquet'")
    key = lambda frame: sorted((-1 if pd.isna(d) else int(d), u, n, int(h)) for d, u, n, h in
                               frame[["doc_id", "unit", "licence", "hits"]].itertuples(index=False))
    assert key(rows) == key(db.execute(licences.scan_sql()).df())
    assert (1, "document", "MIT", 1) in key(rows) and (2, "line", "MIT", 2) in key(rows) and (6, "document", "MIT", 1) in key(rows)
    assert not any(d == 8 for d, *_ in key(rows))
    assert licences.scan(docs.limit(0), licences.known_licences(spark)).count() == 0


def test_whole_licence_texts_are_known(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0",
             "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl"}
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts here")
    texts = {n: (folder / f).read_text("utf-8") for f, n in names.items()}
    docs = [(n, t.upper() if i % 2 else t) for i, (n, t) in enumerate(texts.items())] + [("GPL-2.0", texts["GPL-2.0"].split("How to Apply These")[0])]
    docs += [("part", texts["GPL-3.0"][:20000])]
    found = licences.scan(corpus_session(spark).createDataFrame(docs, "doc_id string, text string"), licences.known_licences(spark))
    assert sorted(r["doc_id"] for r in found.where("unit = 'document' AND licence = doc_id").collect()) == sorted([*texts, "GPL-2.0"])
    assert found.where("unit = 'document'").count() == len(docs) - 1


def test_licence_scan_of_many_lines(spark):
    """A document of 100,000 different lines, with known ones among them, repeated as a row."""
    lines = [f"line number {i}" for i in range(100_000)]
    lines[500] = lines[70_000] = "Released under the MIT License"
    docs = corpus_session(spark).createDataFrame([(1, "\n".join(lines), 0)] * 2, "doc_id long, text string, row int")
    known = licences.known_licences(spark, [("MIT", "released under the mit licence")], [])
    assert [tuple(r) for r in licences.scan(docs, known).collect()] == [(1, "line", "MIT", 2)] * 2


@pytest.mark.parametrize("block,bits", [(3, 7), (4096, 2)])
def test_top_k_equals_sorting_everything(spark, block, bits):
    r = random.Random(6)
    rows = [(i, [r.choice([-1.0, -0.3, 0.0, 0.26, 1.0]) for _ in range(4)], "x") for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 1.0], "x") for i in range(60)]  # ties beyond k
    rows += [(200, None, "x"), (220, [1.0, None, 0.0, 0.0], "x"), (240, [float("nan")] * 4, "x"), (260, [float("inf"), 0.0, 0.0, 0.0], "x"),
             (280, [], "x"), (300, [0.5, 0.5], "x"), (301, [0.25, -0.5], "x"), (None, [1.0] * 4, "x"), (20, rows[20][1], "x"), (7, rows[7][1], "x")]
    vectors = corpus_session(spark).createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    found = top_k.top_k(vectors, F.col("vec_id") % 20 == 0, top_k.Settings(k=20, block_queries=block, pass_bits=bits))
    sound = [(i, np.floor(64 * np.array(np.float32(v), float)).astype(int)) for i, v, _ in rows
             if i is not None and v and None not in v and np.isfinite(v).all()]
    wanted = []
    for query, own in {i: v for i, v in sound if i % 20 == 0}.items():
        best = sorted((-int(own @ v), i) for i, v in sound if i != query and len(v) == len(own))[:20]
        wanted += [(query, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(row) for row in found.collect()) == sorted(wanted)
    assert top_k.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k.top_k(vectors, F.lit(False)).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    """Components beyond 2^25, sums beyond 62 bits, scores beyond a long, beside small ones."""
    r = random.Random(7)
    rows = [(i, [r.choice([-1.0, -0.3, 0.26, 1.0]) * (r.choice([1.0, 4e7, 3e7]) if i % 3 else 1.0) for _ in range(8)]) for i in range(45)]
    rows += [(60, [3.0e7] * 8), (61, [3.0e7] * 8), (62, [-3.0e7] * 8), (80, [1e300, 1.0] + [0.0] * 6), (81, [1e308, -1.0] + [0.0] * 6), (82, [0.0, 2.0**40 + 3] + [0.0] * 6),
             (83, [0.0, 2.0**40 + 2] + [0.0] * 6)]
    vectors = corpus_session(spark).createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = top_k.top_k(vectors, F.col("vec_id") % 20 == 0, top_k.Settings(block_queries=3))
    whole = {i: [int(np.floor(x)) if x > 1e17 else int(np.floor(64 * x)) for x in v] for i, v in rows}
    whole = {i: [64 * x if x > 1e17 else x for x in v] for i, v in whole.items()}
    wanted = []
    for query in (i for i in whole if i % 20 == 0):
        scores = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[query], v)))) for i, v in whole.items() if i != query}
        wanted += [(query, rank, i, scores[i]) for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:20], 1)]
    assert sorted(tuple(row) for row in found.collect()) == sorted(wanted)
