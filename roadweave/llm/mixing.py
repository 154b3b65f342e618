"""Mixing sources to target weights, by budgets handed down a tree domain - language - source.

The token budget goes down the tree. Among siblings it is split by weight; a child that can't use its part (its
capacity is its tokens times the allowed epochs) takes what it can, and the shortage goes to its siblings by weight.
As a node's capacity is that of its leaves, only what all siblings together can't use is left to the ancestors'
siblings. Integer arithmetic throughout: parts are rounded down, so a node may stay some tokens below its budget.

A leaf with budget b and T tokens gives all its documents in b div T full epochs, and in the next epoch the longest
prefix of its documents, in an order seeded by epoch and doc_id, that stays within the rest. The prefix is found
without sorting a leaf: tokens are summed by ranges of the order's hash, and only the range where the budget ends is
sorted.

Defined cases: null languages and sources count as `(none)`; null or empty texts have 0 tokens and stay documents;
rows of a leaf with equal doc_id (also null) stand or fall together; a weight of 0 leaves a branch out; a leaf without
any token gives each document once, if its branch has a weight; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import stored

NONE = "(none)"
LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x20\x09-\x0D]+"
HEX = 15
"""Digits of the order's hash: 60 bits, an integer."""


@dataclass(frozen=True)
class Settings:
    budget_percent: int = 60
    """Of all tokens in the input."""
    epochs: int = 3
    seed: int = 17
    weights: dict[str, int] = field(default_factory=dict)
    """By path, such as `books`, `books/en` or `books/en/src7`, or by name at its depth: `*/en`, `*/*/src7`. Else 1."""
    range_digits: int = 3
    broadcast_leaves: int = 100_000


def tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def position(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch's order."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, HEX), 16, 10).cast("long")


def _weight(depth: int, settings: Settings) -> Column:
    path = F.concat_ws("/", *LEVELS[: depth + 1])
    name = F.concat(F.lit("*/" * depth), F.col(LEVELS[depth]))
    if not settings.weights:
        return F.lit(1).cast("long")
    known = F.create_map(*[F.lit(x) for pair in settings.weights.items() for x in pair])
    return F.coalesce(known[path], known[name], F.lit(1)).cast("long")


def _share(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each parent's `budget` over its children (columns capacity, weight) by weight, within their capacities.

    Children are taken in the order of capacity per weight: each either fits into its part of what is left, or it and
    all after it are limited by weight.
    """
    big = "decimal(38,0)"
    parent = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = parent.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    placed = children.select(
        "*", F.sum("weight").over(parent).alias("all_weight"),
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("filled"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("filled_weight"))
    placed = placed.withColumn("full", F.col("capacity").cast(big) * (F.col("all_weight") - F.col("filled_weight")).cast("decimal(18,0)")
                               <= F.col("weight").cast(big) * (F.col("budget") - F.col("filled")).cast("decimal(18,0)"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(parent), F.lit(0))
    weight_left = F.sum(F.when(~F.col("full"), F.col("weight"))).over(parent)
    part = F.expr("CAST(weight AS DECIMAL(18,0)) * CAST(left AS DECIMAL(20,0)) DIV weight_left").cast("long")
    return placed.withColumns({"left": left, "weight_left": weight_left}).withColumn(
        "budget", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop(
        "all_weight", "filled", "filled_weight", "full", "left", "weight_left")


def budgets(leaves: DataFrame, settings: Settings) -> DataFrame:
    """(domain, lang, source, tokens, budget) of every leaf with a weight."""
    for depth in range(3):
        leaves = leaves.withColumn(f"w{depth}", _weight(depth, settings))
    leaves = leaves.where("w0 > 0 AND w1 > 0 AND w2 > 0").withColumn("capacity", F.col("tokens") * settings.epochs)
    node = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.first("w0").alias("weight"),
                                       F.first("total").alias("total"))
    node = node.withColumn("budget", F.expr(f"total * {settings.budget_percent} DIV 100"))
    shared = _share(node, [], "domain").select("domain", "budget")
    for depth, parents in ((1, ["domain"]), (2, ["domain", "lang"])):
        columns = [*parents, LEVELS[depth]]
        node = leaves.groupBy(*columns).agg(F.sum("capacity").alias("capacity"), F.first(f"w{depth}").alias("weight"),
                                           F.sum("tokens").alias("tokens"))
        shared = _share(node.join(shared, parents), parents, LEVELS[depth]).select(*columns, "budget", "tokens")
        shared = shared if depth == 2 else shared.drop("tokens")
    return shared


def cuts(slim: DataFrame, settings: Settings) -> DataFrame:
    """(domain, lang, source, budget, whole_epochs, last_position): what each leaf gives.

    `slim` has a row (doc_id, domain, lang, source, tokens) for each document.
    """
    keys = list(LEVELS)
    leaves = slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    leaves = stored(leaves)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves.withColumn("total", F.lit(total).cast("long")), settings)
    given = stored(given.withColumn("whole_epochs", F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 1 END").cast("int"))
                   .withColumn("rest", F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END")).drop("tokens"))
    ranges = 16 ** (HEX - settings.range_digits)
    placed = slim.join(_small(given, settings), keys).where("rest > 0").select(
        *keys, "rest", position(settings.seed, F.col("whole_epochs"), F.col("doc_id")).alias("position"), F.col("tokens").alias("n"))
    placed = placed.withColumn("range", F.expr(f"position DIV {ranges}"))
    up_to = Window.partitionBy(*keys).orderBy("range")
    sums = placed.groupBy(*keys, "range").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("upto", F.sum("n").over(up_to))
    # the first range that goes beyond the rest: all ranges before it are in, some of its documents may be
    broken = stored(sums.where("upto > rest").groupBy(*keys).agg(F.min("range").alias("range"), F.min_by(F.col("upto") - F.col("n"), "range").alias("before")))
    inside = placed.join(_small(broken, settings), [*keys, "range"]).groupBy(*keys, "position").agg(
        F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    order = Window.partitionBy(*keys).orderBy("position")
    last = inside.withColumn("upto", F.col("before") + F.sum("n").over(order)).where("upto <= rest").groupBy(*keys).agg(
        F.max("position").alias("last"))
    return stored(given.join(broken.select(*keys, "range"), keys, "left").join(last, keys, "left").select(
        *keys, "budget", "whole_epochs", F.coalesce("last", F.col("range") * F.lit(ranges) - 1, F.lit(-1)).alias("last_position")))


def _small(leaves: DataFrame, settings: Settings) -> DataFrame:
    """A stored table of leaves is sent to all tasks only if it has few rows; else the join shuffles."""
    return F.broadcast(leaves) if leaves.count() <= settings.broadcast_leaves else leaves


def mix(docs: DataFrame, domain: Column, settings: Settings = Settings()) -> DataFrame:
    """A row of `docs` for each epoch it is given in, with its domain, tokens and epoch (from 0).

    `domain` is an expression of the columns of `docs`, such as of `source`.
    """
    keys = [f"__{k}" for k in LEVELS]
    named = docs.withColumns({
        "__domain": F.coalesce(domain, F.lit(NONE)), "__lang": F.coalesce("lang", F.lit(NONE)),
        "__source": F.coalesce("source", F.lit(NONE)), "__tokens": tokens("text")})
    slim = stored(named.select("doc_id", *[F.col(k).alias(n) for k, n in zip(keys, LEVELS)], F.col("__tokens").alias("tokens")))
    given = cuts(slim, settings)
    given = given.select(*[F.col(n).alias(k) for k, n in zip(keys, LEVELS)], F.col("whole_epochs").alias("__whole"), F.col("last_position").alias("__last"))
    joined = named.join(_small(given, settings), keys)
    part = position(settings.seed, F.col("__whole"), F.col("doc_id")) <= F.col("__last")
    epochs = F.col("__whole") + part.cast("int")
    made = joined.withColumn("__epochs", epochs).where("__epochs > 0").withColumn(
        "__epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
    kept = [c for c in docs.columns if c.lower() not in ("domain", "tokens", "epoch")]
    return made.select(*[f"`{c}`" for c in kept], F.col("__domain").alias("domain"), F.col("__tokens").alias("tokens"),
                       F.col("__epoch").alias("epoch"))


def mix_sql(domain: str, settings: Settings) -> str:
    """The same mix of `documents` as one DuckDB statement, without the ranges: (doc_id, domain, lang, source, tokens, epoch)."""
    def weight(depth: int) -> str:
        path = " || '/' || ".join(LEVELS[: depth + 1])
        cases = "".join(f" WHEN {path} = '{k}' THEN {v}" for k, v in settings.weights.items() if "*" not in k and k.count("/") == depth)
        cases += "".join(f" WHEN {LEVELS[depth]} = '{k.split('/')[-1]}' THEN {v}" for k, v in settings.weights.items()
                         if k.startswith("*/" * depth) and k.count("/") == depth and k.count("*") == depth)
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    def share(name: str, source: str, parents: str, child: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        return f"""
{name}_a AS (SELECT *, sum(weight) OVER ({by})::HUGEINT AS all_weight,
    coalesce(sum(capacity) OVER b, 0)::HUGEINT AS filled, coalesce(sum(weight) OVER b, 0)::HUGEINT AS filled_weight FROM {source}
    WINDOW b AS ({by} ORDER BY capacity::DOUBLE / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT *, capacity::HUGEINT * (all_weight - filled_weight) <= weight::HUGEINT * (budget - filled) AS is_full FROM {name}_a),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN is_full THEN capacity ELSE
    (weight::HUGEINT * (budget - coalesce(sum(capacity) FILTER (is_full) OVER ({by}), 0)::HUGEINT)
     // (sum(weight) FILTER (NOT is_full) OVER ({by}))::HUGEINT) END::BIGINT AS budget FROM {name}_b)"""

    return f"""
WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {settings.epochs} AS capacity,
    {weight(0)} AS w0, {weight(1)} AS w1, {weight(2)} AS w2 FROM d GROUP BY ALL HAVING w0 > 0 AND w1 > 0 AND w2 > 0),
n0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, any_value(w0) AS weight,
    (SELECT sum(tokens)::BIGINT FROM d) * {settings.budget_percent} // 100 AS budget FROM leaf GROUP BY domain),{share("s0", "n0", "", "domain")},
n1 AS (SELECT domain, lang, sum(leaf.capacity)::BIGINT AS capacity, any_value(w1) AS weight, any_value(budget) AS budget
    FROM leaf JOIN s0 USING (domain) GROUP BY domain, lang),{share("s1", "n1", "domain", "lang")},
n2 AS (SELECT leaf.domain, leaf.lang, source, leaf.tokens, leaf.capacity, w2 AS weight, budget
    FROM leaf JOIN s1 USING (domain, lang)),{share("s2", "n2", "domain, lang", "source")},
g AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM s2),
p AS (SELECT d.*, whole, rest, substr(md5('{settings.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, {HEX}) AS place
    FROM d JOIN g USING (domain, lang, source)),
q AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) <= rest AND rest > 0 AS more FROM p)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, whole + more::INT))::BIGINT AS epoch FROM q"""
