"""Benchmark decontamination: pigeonhole pieces found exactly, verified by Myers' bit-parallel edit distance.

A document holds a benchmark item if some passage of it is within k edits of the item, k = error_rate x item length,
both with lower case and single spaces. An item is cut into k + 1 pieces: k edits leave one piece untouched, so the
exact hits of all pieces (one automaton over all of them, one pass over each text) miss nothing. Around the hits the
edit distance decides.

The benchmark goes to the tasks in blocks of bounded size, one pass over the documents each; documents never move.
What a block gives is written before the next but one is read, so the driver holds two blocks at most.

Defined cases: null or empty items match nothing, null or empty texts hold nothing; items with the same text are
reported each, repeated documents too; a text is searched whole, whatever its length; of several passages the nearest
counts, and of equal ones the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from roadweave.llm.common import stored, with_results


@dataclass(frozen=True)
class Settings:
    error_rate: float = 0.08
    block_chars: int = 4_000_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """One benchmark item with its bit masks."""

    def __init__(self, item_id: int, text: str, errors: int):
        self.item_id, self.text, self.errors = item_id, text, errors
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> Iterator[tuple[int, str]]:
        number, size = self.errors + 1, len(self.text)
        for q in range(number):
            first, last = size * q // number, size * (q + 1) // number
            yield first, self.text[first:last]

    def nearest(self, window: str) -> tuple[int, int]:
        """Least edit distance of the item to any passage of `window`, and where the first such passage ends."""
        at = window.find(self.text)
        if at >= 0:
            return 0, at + len(self.text)
        size = len(self.text)
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score, best, end = full, 0, size, size + 1, 0
        masks = self.masks
        for i, c in enumerate(window):
            eq = masks.get(c, 0)
            down = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            more = minus | (full & ~(across | plus))
            less = plus & across
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            if score < best:
                best, end = score, i + 1
            more = more << 1 & full
            plus = (less << 1 & full) | (full & ~(down | more))
            minus = more & down
        return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.patterns = [Pattern(i, t, int(len(t) * settings.error_rate)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        for number, pattern in enumerate(self.patterns):
            for offset, piece in pattern.pieces():
                if piece in self.automaton:
                    self.automaton.get(piece).append((number, offset, len(piece)))
                else:
                    self.automaton.add_word(piece, [(number, offset, len(piece))])
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a hit, the stretches of text in which a passage would lie; overlapping ones are joined."""
        found: dict[int, list[list[int]]] = {}
        for last, hits in self.automaton.iter(text):
            for number, offset, size in hits:
                pattern = self.patterns[number]
                start = last + 1 - size - offset
                window = [max(0, start - pattern.errors), min(len(text), start + len(pattern.text) + pattern.errors)]
                found.setdefault(number, []).append(window)
        for number, windows in found.items():
            windows.sort()
            joined = windows[:1]
            for window in windows[1:]:
                if window[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], window[1])
                else:
                    joined.append(window)
            found[number] = joined
        return found

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the plain text) of every item that the text holds."""
        text = plain(text)
        if not self.ready or not text:
            return []
        result = []
        for number, windows in sorted(self.windows(text).items()):
            pattern = self.patterns[number]
            distance, end = min((d, start + e) for start, last in windows for d, e in [pattern.nearest(text[start:last])])
            if distance <= pattern.errors:
                result.append((pattern.item_id, distance, end))
        return result


def item_blocks(items: DataFrame, settings: Settings = Settings()) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about `block_chars` characters, each read when it is its turn."""
    items = items.where("text IS NOT NULL").select("item_id", "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    number = max(1, math.ceil(size / settings.block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(number))
    for k in range(number):
        rows = items.where(part == k).orderBy("item_id", "text").collect()
        yield [(i, plain(t)) for i, t in rows if plain(t)]


HIT = StructType([StructField("item_id", LongType()), StructField("distance", IntegerType()), StructField("end", IntegerType())])


def _with_hits(docs: DataFrame, items: list[tuple[int, str]], settings: Settings, column: str, only_whether: bool) -> DataFrame:
    matcher: list[Matcher] = []  # built once in each task

    def work(texts: list[str | None]) -> list:
        if not matcher:
            matcher.append(Matcher(items, settings))
        hits = [matcher[0].matches(t) for t in texts]
        if only_whether:
            return [[bool(h) for h in hits]]
        return [[[{"item_id": i, "distance": d, "end": e} for i, d, e in h] for h in hits]]

    return with_results(docs, ["text"], [StructField(column, BooleanType() if only_whether else ArrayType(HIT))], work)


def matches(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row (doc_id, item_id, distance, end) for each document and each benchmark item that it holds."""
    found: list[DataFrame] = []
    for block in item_blocks(items, settings):
        if found:
            found[-1] = stored(found[-1])
        found.append(_with_hits(docs.select("doc_id", "text"), block, settings, "hits", False).select("doc_id", F.inline("hits")))
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    columns = docs.columns
    for k, block in enumerate(item_blocks(items, settings)):
        docs = stored(docs) if k else docs
        docs = _with_hits(docs, block, settings, "__leaked", True).where("NOT __leaked").select(*[f"`{c}`" for c in columns])
    return docs
