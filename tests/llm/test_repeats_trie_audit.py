"""Operators 11 to 13 against plain versions on odd rows."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import filter_audit, prefix_trie, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, anchor long, k1 string, part string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 5, "x", "y") for i, t, lang in rows], DOCS)


def odd_texts(seed, size=60):
    """Texts that share passages, with repeated lines, copies, near copies, nulls and equal ids."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op é ü x".split(" ")) + str(rng.randrange(40))
    passages = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 60, 90, 200)] + ["la la la " * 60, "one two " * 30]
    rows = []
    for i in range(size):
        parts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(3)] + rng.sample(passages, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((rng.choice([i, i, i, rng.randrange(size), None]), rng.choice([" ", "\n", "\t \r\n"]).join(parts), rng.choice(["en", "de", None, ""])))
    rows += [(7, None, "en"), (None, None, None), (3, "", "en"), (90, rows[0][1], "en"), (-5, rows[1][1], "en"), rows[2], rows[2],
             (91, rows[5][1] + " tail", "de"), (92, "head " + rows[5][1], "fr"), (93, " \t\n ", "fr"), (94, passages[2] + " " + passages[2], "en")]
    return rows


def plain_repeats(rows):
    least = {}
    split = [WORD.findall(text or "") for _, text, _ in rows]
    for (doc, _, _), words in zip(rows, split):
        for s in range(len(words) - 49) if doc is not None else ():
            key = tuple(words[s : s + 50])
            least[key] = min(least.get(key, doc), doc)
    found = []
    for (doc, _, _), words in zip(rows, split):
        gone = set()
        for s in range(len(words) - 49) if doc is not None else ():
            if least[tuple(words[s : s + 50])] < doc:
                gone |= set(range(s, s + 50))
        found.append((doc, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return found


def by_none(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_all_windows(spark, seed):
    rows = odd_texts(seed)
    made = [tuple(r) for r in repeats.without_repeats(documents(spark, rows)).collect()]
    assert by_none(made) == by_none(plain_repeats(rows))
    assert 0 < sum(r[2] for r in made) < sum(r[1] for r in made)


def test_repeats_with_a_hot_passage_and_a_long_text(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    rows = [(i, f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(40))} {passage} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(40))}", "en")
            for i in range(300)]
    rows.append((-1, " ".join(f"w{rng.randrange(10**5)}" for _ in range(40_000)) + " " + passage, "en"))
    made = {r["doc_id"]: r["n_removed"] for r in repeats.without_repeats(documents(spark, rows)).collect()}
    assert made == {i: 60 for i in range(300)} | {-1: 0}


def test_repeats_of_an_empty_table(spark):
    assert repeats.without_repeats(documents(spark, [])).count() == 0


def test_run_hashes_and_least_places():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 500).astype(np.uint64) * np.uint64(0x1234567)
    found = repeats.run_hashes(words, 7)
    seen = {}
    for i, h in enumerate(found):
        assert seen.setdefault(tuple(words[i : i + 7]), h) == h
    assert len(set(seen.values())) == len(seen)
    values = rng.integers(0, 20, 200).astype(np.uint64)
    for width in (1, 2, 5, 8, 31):
        assert repeats.least_places(values, width).tolist() == [int(np.argmin(values[i : i + width])) + i for i in range(200 - width + 1)]
    assert len(repeats.run_hashes(words[:3], 7)) == 0


TURNS = "conv_id long, turn long, role string, text string, node string, depth int"


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    found = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n and m for m in nodes)]
        saved = sum((len(nodes[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in members if convs[c] == node)))
        found.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children), len(leaves), saved,
                      hashlib.sha256(ends.encode()).hexdigest()))
    return found


def odd_turns(seed, deepest=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 130), 90):
        for turn in range(rng.randrange(deepest)):
            text = rng.choice(["hello there", "a  b\tc", "", None, "x y", "rare " + str(rng.randrange(9))]) if turn > 1 else "hi"
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", None]) if turn else "user", text))
    return rows + [(None, 0, "user", "nobody"), (None, None, None, None)] + rows[:5]


@pytest.mark.parametrize("group, seed", [(200_000, 1), (200_000, 2), (0, 3)])
def test_trie_equals_a_plain_one(spark, monkeypatch, group, seed):
    """Also where no subtree is small enough for one task."""
    monkeypatch.setattr(prefix_trie, "GROUP_ENTRIES", group)
    rows = odd_turns(seed)
    made = prefix_trie.trie(spark.createDataFrame([(*r, "n", 1) for r in rows], TURNS))
    assert by_none(tuple(r) for r in made.collect()) == by_none(plain_trie(rows))


def test_trie_of_a_deep_conversation_and_of_many_ends(spark):
    rows = [(c, t, "user", "same words") for c in range(1, 400) for t in range(3)] + [(0, t, "user", "same words") for t in range(150)]
    made = [tuple(r) for r in prefix_trie.trie(spark.createDataFrame([(*r, "n", 1) for r in rows], TURNS)).collect()]
    assert by_none(made) == by_none(plain_trie(rows))
    assert len(made) == 151


def test_trie_of_no_conversation(spark):
    nothing = prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", "n", 1)], TURNS))
    assert nothing.count() == 0 and nothing.columns[0] == "conv_id"


def test_long_lists_of_ends_are_digested_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 5)
    ended = spark.createDataFrame([([b"n"], 1, c) for c in range(1200)] + [([b"m"], 1, 3)], "chain array<binary>, depth int, conv_id long")
    found = {bytes(r["node"]): r["ends_sha256"] for r in prefix_trie._end_digests(ended).collect()}
    assert found == {b"n": hashlib.sha256(",".join(map(str, range(1200))).encode()).hexdigest(), b"m": hashlib.sha256(b"3").hexdigest()}


def plain_audit(rows, labels):
    known = [i for i, _, _ in rows if i is not None]
    masks = []
    for doc, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(letter for letter, bad in zip("ABCDE", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)), doc is not None and any(i < doc and (t or "") == text for i, t, _ in rows if i is not None)]) if bad)
        good, toxic = (any(i == doc and i is not None and label[k] == 1 for i, *label in labels) for k in (0, 1))
        masks.append((lang or "", fails, good, toxic))
    assert known
    found = []
    for part in {m[0] for m in masks}:
        own, shapley, steps = [m for m in masks if m[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order):
                gone, left = [m for m in left if letter in m[1]], [m for m in left if letter not in m[1]]
                shapley[letter] += len(gone)
                failing = [m for m in own if letter in m[1]]
                steps.append((part, "".join(order), step + 1, len(left), len(gone), len(failing) - len(gone),
                              sum(m[1] == letter for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone), letter))
        found += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return found


def audit_rows(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, rng.randrange(50), None]), t, lang) for i, t, lang in odd_texts(seed)]
    rows += [(200 + i, rng.choice(["LOUD " * 250, "w%d " % i + " ".join(f"x{k}" for k in range(260)), "a|b " * 220, None, ""]), rng.choice(["en", "fr", None]))
             for i in range(60)]
    labels = [(rng.choice([None, *range(260)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    return rows, labels


def test_audit_equals_applying_every_order(spark):
    rows, labels = audit_rows(4)
    made = filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in made.collect()) == sorted(plain_audit(rows, labels))


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
    one = filter_audit.audit(documents(spark, [(1, None, None)]), labels)
    assert one.count() == 600 and one.agg(F.sum("kept"), F.max("removed")).first()[:] == (240, 1)


def test_carry_save_counts():
    rng = np.random.default_rng(1)
    planes, plain = [], np.zeros(32, np.int64)
    for size in (0, 1, 7, 1000):
        words, times = rng.integers(0, 1 << 32, size, dtype=np.uint32), rng.integers(0, 1000, size)
        planes = filter_audit.add_words(planes, words, times)
        for bit in range(32):
            plain[bit] += times[(words >> np.uint32(bit)) & 1 == 1].sum()
    assert filter_audit.bit_counts(planes) == plain.tolist() and all(len(p) < 3 for p in planes)
