"""Language identification, toxicity and language-model scoring against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from roadweave.llm import language_id, log_bilinear, queries, toxicity
from roadweave.llm.common import code_points, corpus_session, gram_buckets, range_sums

LETTERS = {"aa": "abcde ", "zz": "vwxyz "}


def made_text(random_, letters, words=30):
    return " ".join("".join(random_.choice(letters.strip()) for _ in range(random_.randint(2, 6))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    rows = [(i, made_text(r, LETTERS[lang]), lang) for i in range(40) for lang in LETTERS]
    return corpus_session(spark).createDataFrame(rows + [(900, None, "aa"), (901, "", "aa"), (902, "abc", None)],
                                                 "doc_id long, text string, lang string")


def test_range_sums_of_empty_and_last_ranges():
    values = np.arange(10, dtype=float)
    starts, ends = np.array([0, 3, 9, 9, 10, 2]), np.array([3, 3, 10, 9, 10, 10])
    assert range_sums(values, starts, ends).tolist() == [values[a:b].sum() for a, b in zip(starts, ends)]


def test_language_scores_equal_a_plain_count(labelled):
    settings = language_id.Settings(orders=(1, 2, 3), bits=12)
    model = language_id.train(labelled, settings)
    rows = [r for r in labelled.collect() if r["text"] and r["lang"]]
    counts = {lang: Counter() for lang in LETTERS}

    def grams(text):
        points, _, _ = code_points([text.lower()])
        return [int(b) for n in settings.orders for b in gram_buckets(points, n, settings.bits)]

    for row in rows:
        counts[row["lang"]].update(grams(row["text"]))
    for text in ("abc vwx", "zzz y", "e", "été ÀÉ", "abcde" * 50):
        plain = [math.log(40 / 80) + sum(math.log((counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * 4096)) for b in grams(text))
                 for lang in model.languages]
        best, score = language_id.scores([text], model)
        assert model.languages[best[0]] == model.languages[int(np.argmax(plain))] and 0 < score[0] <= 1


def test_language_of_odd_rows(spark, labelled):
    model = language_id.train(labelled)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 !?", 0), (None, "abcde abc", 0), (4, "xyz" * 40000, 0), (4, "xyz" * 40000, 0)],
                                 "doc_id long, text string, SCORE int")
    rows = language_id.predict(docs, model).collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "aa", "zz", "zz"]
    assert [r["score"] for r in rows][:3] == [0, 0, 0] and rows[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score"}
    assert language_id.predict(docs.limit(0), model).count() == 0
    nothing = language_id.train(labelled.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op8_language_id"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet"), "doc_id")
    held = [r["lang"] == r["lang_pred"] for r in rows.where("held_out").collect()]
    assert len(held) > 200 and sum(held) / len(held) > 0.98


@pytest.fixture(scope="module")
def insults():
    r = random.Random(5)
    texts, labels = [], []
    for i in range(400):
        words = made_text(r, "abcdefgh ", 60).split()
        number = 0 if i % 4 else r.randint(2, 12)
        for _ in range(number):
            words[r.randrange(60)] = r.choice(["zorkil", "wixxen", "zorkan"])
        texts.append(" ".join(words))
        labels.append(int(number > 0))
    return texts, np.array(labels)


def test_severity_rises_with_grade_and_cuts_are_ordered(insults):
    texts, labels = insults
    settings = toxicity.Settings(bits=16)
    buckets = toxicity.choose(texts, labels > 0, settings)
    grades = toxicity.graded(texts, labels > 0, buckets, settings)
    model = toxicity.fit(texts, grades, buckets, settings)
    above = toxicity.chances(texts, model)
    assert (np.diff(model.cuts) > 0).all() and (np.diff(above, axis=1) <= 0).all()
    assert set(grades) == {0, 1, 2, 3} and ((above[:, 0] >= 0.5) == (labels > 0)).mean() > 0.99
    severity = above.sum(axis=1)
    means = [severity[grades == g].mean() for g in range(4)]
    assert means == sorted(means) and means[0] < 0.1 and means[3] > 2.5


def plain_grams(text, settings):
    """How often each hashed n-gram occurs, gram by gram."""
    found = Counter()
    for n in settings.orders:
        for i in range(len(text) - n + 1):
            points, _, _ = code_points([text.lower()[i : i + n]])
            found[int(gram_buckets(points, n, settings.bits)[0])] += 1
    return found


def plain_chance(x, weights, cuts, grade):
    """P(grade) as the difference of two neighbouring P(grade > j)."""
    above = [1.0, *[1 / (1 + math.exp(cut - sum(weights[k] * v for k, v in x.items()))) for cut in cuts], 0.0]
    return above[grade] - above[grade + 1]


def test_toxicity_equals_plain_loops(insults):
    texts, labels = [t[:120] for t in insults[0][:60]], insults[1][:60]
    settings = toxicity.Settings(bits=14, least_texts=2, least_log_odds=1.0, features=40, steps=3)
    grams = [plain_grams(t, settings) for t in texts]
    # the choice: n-grams far more frequent among texts of the positive kind, best first
    often = [Counter(k for g, label in zip(grams, labels) if label == kind for k in g) for kind in (0, 1)]
    times = [Counter(), Counter()]
    for g, label in zip(grams, labels):
        times[label].update(g)
    totals = [sum(t.values()) for t in times]
    number = [int((labels == 0).sum()), int((labels == 1).sum())]
    gains = []
    for k in times[1]:
        rates = [(times[kind][k] + 0.5) / (totals[kind] + 1) for kind in (0, 1)]
        odds = [math.log((often[kind][k] + 0.5) / (number[kind] + 1)) for kind in (0, 1)]
        if times[1][k] >= 2 and rates[1] > 2 * rates[0] and often[1][k] >= 2 and odds[1] - odds[0] >= 1.0:
            expected = (often[0][k] + often[1][k]) * number[1] / sum(number)
            gains.append((-((often[1][k] - expected) ** 2) / expected, k))
    buckets = toxicity.choose(texts, labels > 0, settings)
    assert sorted(k for _, k in sorted(gains)[:40]) == buckets.tolist() and len(buckets) > 10
    # scores
    grades = toxicity.graded(texts, labels > 0, buckets, settings)
    model = toxicity.fit(texts, grades, buckets, settings)
    place = {k: i for i, k in enumerate(buckets.tolist())}
    features = [{place[k]: math.log2(1 + n) for k, n in g.items() if k in place} for g in grams]
    above = toxicity.chances(texts, model)
    for x, row in zip(features, above):
        assert row.tolist() == pytest.approx([sum(plain_chance(x, model.weights, model.cuts, g) for g in range(j + 1, 4)) for j in range(3)], abs=1e-9)
    # the fit: each step follows the slope of the mean negative log-likelihood, here by differences

    def loss(x):
        cuts = [x[len(buckets)]]
        for step in x[len(buckets) + 1 :]:
            cuts.append(cuts[-1] + math.exp(step))
        data = -sum(math.log(plain_chance(f, x, cuts, int(g))) for f, g in zip(features, grades)) / len(texts)
        return data + settings.shrink / 2 * sum(w * w for w in x[: len(buckets)])

    shares = [min(max(float((grades > j).mean()), 1e-4), 1 - 1e-4) for j in range(3)]
    cuts = np.maximum.accumulate([-math.log(s / (1 - s)) + 1e-3 * j for j, s in enumerate(shares)])
    x = [0.0] * len(buckets) + [cuts[0], *[math.log(max(b - a, 1e-3)) for a, b in zip(cuts, cuts[1:])]]
    mean, power = [0.0] * len(x), [0.0] * len(x)
    for step in range(1, settings.steps + 1):
        slope = []
        for i in range(len(x)):
            ends = [loss([*x[:i], x[i] + h, *x[i + 1 :]]) for h in (1e-5, -1e-5)]
            slope.append((ends[0] - ends[1]) / 2e-5)
        for i, g in enumerate(slope):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            power[i] = 0.999 * power[i] + 0.001 * g * g
            x[i] -= settings.rate * (mean[i] / (1 - 0.9**step)) / (math.sqrt(power[i] / (1 - 0.999**step)) + 1e-8)
    assert model.weights.tolist() == pytest.approx(x[: len(buckets)], abs=1e-4)
    assert model.cuts[0] == pytest.approx(x[len(buckets)], abs=1e-4)
    assert np.log(np.diff(model.cuts)).tolist() == pytest.approx(x[len(buckets) + 1 :], abs=1e-4)


def test_toxicity_of_a_very_long_text(insults):
    texts, labels = insults
    settings = toxicity.Settings(bits=16)
    buckets = toxicity.choose(texts, labels > 0, settings)
    model = toxicity.fit(texts, toxicity.graded(texts, labels > 0, buckets, settings), buckets, settings)
    long = "abc " * 400_000
    calm, rude = toxicity.chances([long, long + "zorkil wixxen zorkan zorkil"], model)
    assert calm[0] < settings.flag_at <= rude[0]
    assert (toxicity.chances(["zorkil wixxen", long, "abc"], model)[1] == calm).all()


def test_toxicity_of_odd_rows(spark, insults):
    texts, labels = insults
    docs = corpus_session(spark).createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, None), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, settings=toxicity.Settings(bits=16))
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "abc zorkil wixxen abc", 9), (3, "abc zorkil wixxen abc", 9)],
                                "doc_id long, text string, grade int")
    rows = toxicity.score(odd, model).collect()
    assert [r["toxic"] for r in rows] == [False, False, True, True] and rows[2] == rows[3] and rows[0]["severity"] == rows[1]["severity"]
    assert toxicity.score(odd.limit(0), model).count() == 0
    untaught = toxicity.train(docs, marks.where("toxic = 0"), settings=toxicity.Settings(bits=16))
    assert {(r["severity"], r["toxic"]) for r in toxicity.score(odd, untaught).collect()} == {(0.0, False)}


def test_language_model_equals_plain_counts_and_beats_them(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op7_lm_score"](spark, path).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in log_bilinear.tokens_of(t))
    total = sum(counts.values())
    for row in rows:
        tokens = log_bilinear.tokens_of(texts[row["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[row["doc_id"]], len(tokens), total)
        assert row["n_known"] == sum(w in counts for w in tokens) and row["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_model_probabilities_add_up_to_one(spark):
    texts = [f"{w} {v} {w}x a" for w in ("the", "of", "Über", "y") for v in ("cat", "dog", "to", "bc")] * 3
    docs = corpus_session(spark).createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    settings = log_bilinear.Settings(head=5, buckets=3, dictionary=9, size=8, steps=60)
    model = log_bilinear.train(docs, settings)
    counts = Counter(w for t in texts for w in log_bilinear.tokens_of(t))
    assert model.tokens == sum(counts.values()) and model.vocabulary == len(counts)
    # every known word and one unknown word of each bucket, alone in a text: P(word | start) P(end | word)
    unknown, k = {}, 0
    while len(unknown) < 3:
        word = f"unknown{k}".encode()
        k += 1
        if word not in counts:
            unknown.setdefault(zlib.crc32(word[-3:]) % 3, word)
    words = [w for w in counts if w != log_bilinear.END] + list(unknown.values())
    single = spark.createDataFrame([(i, w.decode()) for i, w in enumerate(words)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in log_bilinear.score(single, model).collect()}
    ends = log_bilinear.class_log_probabilities(np.arange(1 + model.head + 3), model.network)[:, 0]
    classes = log_bilinear._Classes(model.words, model.head, 3)
    own = [int(classes.read([w.decode()])[2][0]) for w in words]
    chance = sum(10 ** (scores[i] - ends[c]) for i, c in enumerate(own)) + 10 ** ends[0]
    assert chance == pytest.approx(1, abs=1e-4)
    assert model.bucket_tokens.sum() == sum(counts.values()) - sum(model.word_counts[: model.head + 1])


def test_noise_contrastive_estimation_finds_the_conditional_chances():
    random_ = np.random.default_rng(2)
    truth = random_.dirichlet(np.ones(12) * 0.5, 12)
    pairs = truth * random_.integers(500, 3000, (12, 1))
    network = log_bilinear.fit(pairs, log_bilinear.Settings(size=12, steps=800))
    found = 10.0 ** log_bilinear.class_log_probabilities(np.arange(12), network)
    assert np.abs(found.sum(axis=1) - 1).max() < 1e-4 and np.abs(found - truth).mean() < 0.02


def test_language_model_of_odd_rows(spark):
    docs = corpus_session(spark).createDataFrame([(1, None, 1), (None, "", 1), (2, "A b\x0b a", 1), (2, "A b\x0b a", 1), (3, "Ünknown " * 9000, 1)],
                                                 "doc_id long, text string, score int")
    model = log_bilinear.train(docs.where("doc_id < 3"), log_bilinear.Settings(head=2, buckets=2, size=4, steps=5))
    rows = sorted(log_bilinear.score(docs, model).collect(), key=lambda r: (r["n_tokens"], r["doc_id"] or 0))
    assert [(r["n_tokens"], r["n_known"]) for r in rows] == [(1, 1), (1, 1), (4, 4), (4, 4), (9001, 1)]
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 9 for r in rows)
    empty = log_bilinear.train(docs.limit(0), log_bilinear.Settings(head=2, buckets=2, size=4, steps=5))
    rows = log_bilinear.score(docs, empty).collect()
    assert {(r["n_known"], r["base_score"]) for r in rows} == {(0, 0.0)} and all(math.isfinite(r["score"]) for r in rows)
    assert log_bilinear.score(docs.limit(0), model).count() == 0
