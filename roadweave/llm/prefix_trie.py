"""Conversation prefix trie, by truncation peeling from the deepest turn up.

A conversation is the chain of digests of its prefixes: each turn's digest is made of the digest before it, the role and
the text, so equal digests mean equal sequences of turns.  Peeling starts at the greatest depth.  At depth d the
conversations that end there meet the nodes that survive from below; rows of one prefix become one node with its least
conversation, members, children, leaves and saved tokens; then every chain loses its last turn and the rows go on as the
children of depth d - 1.  Peeling goes by bands of depths (0, 1, 2, 3 to 4, 5 to 8, ...).  Rows of one node are merged by a
shuffle, aggregated before it; where all subtrees of a band are small, which is checked, a task peels whole subtrees
through all depths of the band, else the band is peeled depth by depth with a shuffle each.  Each band is written before
the next; texts never travel with the chains.

The ids that end at a node are digested in order: pieces of the sorted ids are joined where they are, only the pieces of a
node (a row for some thousand ids) come together, and are read as a stream.

Defined results: a null role or text is empty.  Turns are ordered by turn (null first), then role, then text, so repeated
turns have a place.  Rows with a null conv_id belong to no conversation and are left out.  A conversation without turns
ends at the root.  No conversation: no row, not even a root.  Depth is not bounded.  Other
columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from roadweave.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
ROOT = b""
COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
PIECE_CHARS = 65536
GROUP_ENTRIES = 200_000
"""Digests in the chains below one node that a task may peel by itself; a larger subtree is peeled depth by depth by shuffles."""
LOT_ENTRIES = 20_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def crc_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest of role and text, words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("place"), F.unhex(F.md5(whole.cast("binary"))).alias("digest"),
                        F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))


def rebuilt_turns(turns: DataFrame, group: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, base, h) and their rebuilt turns: the first h of the base, then their own after the first h."""
    head = turns.where(F.col("place") < modulus - 1).select("conv_id", "place", "digest", "words")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("last")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (crc_of("conv_id") % modulus).cast("int").alias("h"))
    own = turns.withColumn("h", (crc_of("conv_id") % modulus).cast("int")).where("place >= h").select(
        "conv_id", F.lit(1).alias("part"), "place", "digest", "words")
    lent = head.where(F.col("conv_id") % group == 0).withColumnRenamed("conv_id", "base")
    borrowed = convs.join(lent, "base").where("place < h").select("conv_id", F.lit(0).alias("part"), "place", "digest", "words")
    return convs.select("conv_id"), borrowed.unionByName(own)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of turns -> digests of the prefixes that end with them."""
    for batch in batches:
        chains = []
        for digests in batch.column(1).to_pylist():
            before, chain = ROOT, []
            for digest in digests or []:
                before = hashlib.blake2b(before + digest, digest_size=16).digest()
                chain.append(before)
            chains.append(chain)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.list_(pa.binary())), batch.column(2)], names=["conv_id", "chain", "words"])


def chains(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, chain (digest of each prefix), words (of each turn)."""
    convs, turns = rebuilt_turns(numbered_turns(conversations))
    ordered = turns.unionByName(convs.select("conv_id", F.lit(2).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"),
                                             F.lit(0).alias("words")))
    lists = ordered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "place", "digest", "words"))).alias("t"))
    lists = lists.select("conv_id", F.filter("t", lambda t: t["part"] < 2).alias("t"))
    made = lists.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.words").alias("words")).mapInArrow(
        _chained, "conv_id bigint, chain array<binary>, words array<int>")
    return made.withColumn("depth", F.size("chain"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) -> (node, first id, ids joined by commas), about PIECE_CHARS a piece."""
    held, size, found = [], 0, []

    def end() -> None:
        nonlocal held, size
        if held:
            found.append((held[0][0], held[0][1], ",".join(str(c) for _, c in held)))
        held, size = [], 0

    def given() -> pa.RecordBatch:
        rows, found[:] = list(zip(*found)) or [[], [], []], []
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())],
                                          names=["node", "first", "piece"])

    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (node != held[0][0] or size > PIECE_CHARS):
                end()
            held.append((node, conv))
            size += len(str(conv)) + 1
        if found:
            yield given()
    end()
    if found:
        yield given()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> SHA-256 of each node's whole list; a node may go on over many batches."""
    node = sha = None
    for batch in batches:
        nodes, hashes = [], []
        for at, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if at != node:
                if sha:
                    nodes.append(node)
                    hashes.append(sha.hexdigest())
                node, sha = at, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def _end(chain: str) -> Column:
    """The node at the end of a chain."""
    return F.when(F.size(chain) > 0, F.element_at(chain, -1)).otherwise(F.lit(ROOT))


def _node_type() -> StructType:
    kinds = {"node": BinaryType(), "up": BinaryType(), "depth": IntegerType(), "chain": ArrayType(BinaryType()),
             "words": ArrayType(IntegerType()), "conv_id": LongType()} | {c: LongType() for c in COUNTS}
    return StructType([StructField(n, k) for n, k in kinds.items()])


def _end_digests(ended: DataFrame) -> DataFrame:
    ids = ended.select(_end("chain").alias("node"), "conv_id")
    pieces = ids.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        _pieces, "node binary, first bigint, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def _contributions(ended: DataFrame, surviving: DataFrame | None, least: int, most: int) -> DataFrame:
    """What nodes of the depths `least` to `most` are made of: conversations that end there, and nodes of depth `most` + 1
    without their last turn, each a child of the node at the end of its chain."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = ended.where(F.col("depth").between(least, most)).select(
        "chain", "words", "conv_id", one.alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    if surviving is None:
        return rows
    return rows.unionByName(surviving.select(
        F.slice("chain", F.lit(1), F.lit(most)).alias("chain"), F.slice("words", F.lit(1), F.lit(most)).alias("words"), "conv_id", "n_convs",
        one.alias("n_children"), "n_leaves", "saved_tokens"))


def _merged(rows: DataFrame) -> DataFrame:
    """Contributions to one node as one row."""
    return rows.groupBy(_end("chain").alias("node")).agg(
        F.first("chain").alias("chain"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in COUNTS])


def _one_depth(merged: DataFrame) -> DataFrame:
    """Merged contributions to nodes of one depth -> the nodes."""
    own = F.when(F.size("words") > 0, (F.col("n_convs") - 1) * F.element_at("words", -1)).otherwise(0)
    up = F.when(F.size("chain") > 1, F.element_at("chain", -2)).when(F.size("chain") == 1, F.lit(ROOT))
    return merged.select(
        "node", up.alias("up"), F.size("chain").alias("depth"), "chain", "words", "conv_id", "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + own).alias("saved_tokens"))


def peel(rows: list[tuple], least: int) -> Iterator[tuple]:
    """Contributions to nodes of any depth from `least` on -> the nodes, deepest first; those of depth `least` with their chains."""
    levels: dict[int, dict[bytes, list]] = {}

    def merge(depth: int, chain: list, words: list, conv: int, counts: tuple) -> None:
        held = levels.setdefault(depth, {}).get(chain[depth - 1])
        if held is None:
            levels[depth][chain[depth - 1]] = [chain, words, conv, *counts]
        else:
            held[2] = min(held[2], conv)
            held[3:] = map(add, held[3:], counts)

    for chain, words, conv, *counts in rows:
        merge(len(chain), chain, words, conv, counts)
    for depth in range(max(levels, default=0), least - 1, -1):
        for node, (chain, words, conv, n_convs, n_children, n_leaves, saved) in levels.pop(depth, {}).items():
            n_leaves, saved = max(n_leaves, 1), saved + (n_convs - 1) * words[depth - 1]
            last = depth == least
            yield (node, chain[depth - 2] if depth > 1 else ROOT, depth, chain[:depth] if last else None, words[:depth] if last else None,
                   conv, n_convs, n_children, n_leaves, saved)
            if not last:
                merge(depth - 1, chain, words, conv, (n_convs, 1, n_leaves, saved))


def _peeled(least: int, kind: pa.Schema) -> Callable:
    """Rows sorted by `top` -> nodes; groups of one top stay together, some thousand rows are peeled at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, top = [], 0, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for of, *row in zip(*columns):
                if of != top and entries > LOT_ENTRIES:
                    yield given(held)
                    held, entries = [], 0
                top = of
                held.append(row)
                entries += len(row[0])
        if held:
            yield given(held)

    def given(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*peel(rows, least)), kind)], schema=kind)

    return run


def _cuts(deepest: int) -> list[tuple[int, int]]:
    """Bands of depths, deepest first: 0, 1, 2, 3 to 4, 5 to 8, 9 to 16, ..."""
    bands, least, most = [(0, 0)], 1, 1
    while least <= deepest:
        bands.append((least, min(most, deepest)))
        least, most = most + 1, 2 * most
    return bands[::-1]


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    ended = stored(chains(conversations))
    deepest = ended.agg(F.max("depth")).first()[0]
    if deepest is None:
        return _named(ended.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"),
                                   *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(EMPTY_SHA).alias("ends_sha256")).where("false"))
    found, surviving = [], None
    for least, most in _cuts(deepest):
        if most > least:
            merged = _merged(_contributions(ended, surviving, least, most)).withColumn("top", F.element_at("chain", least))
            largest = merged.groupBy("top").agg(F.sum(F.size("chain")).alias("entries")).agg(F.max("entries")).first()[0] or 0
            if largest <= GROUP_ENTRIES:
                columns = ["top", "chain", "words", "conv_id", *COUNTS]
                nodes = merged.repartition("top").sortWithinPartitions("top").select(*columns).mapInArrow(
                    _peeled(least, to_arrow_schema(_node_type())), _node_type())
                found.append(stored(nodes))
                surviving = found[-1].where(F.col("depth") == least)
                continue
        for depth in range(most, least - 1, -1):
            found.append(stored(_one_depth(_merged(_contributions(ended, surviving, depth, depth)))))
            surviving = found[-1]
    every = reduce(DataFrame.unionByName, [f.select("node", "up", "conv_id", "depth", *COUNTS) for f in found])
    # the children of the root, which may be nearly all nodes, need no join
    root = surviving.agg(F.min("conv_id"))
    top = every.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root.scalar()))
    parents = every.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    rest = every.where("depth > 1").join(parents, "up").select(*top.columns)
    return _named(top.unionByName(rest).join(_end_digests(ended), "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *COUNTS, "ends_sha256")


CRC_SQL = """list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"""

TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor({CRC_SQL}, 4294967295) % 4 AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
    FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS node FROM c, unnest(range(0, len(turns) + 1)) AS r(d)),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * len(regexp_extract_all(node[depth].text, '{WORD}')) ELSE 0 END AS own
    FROM p GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
u AS (SELECT a AS depth, node[1:a] AS node, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM m, unnest(range(0, m.depth + 1)) AS r(a) GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
    u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u ON u.depth = m.depth AND u.node = m.node
LEFT JOIN m q ON q.depth = m.depth - 1 AND q.node = m.node[1:m.depth - 1] AND m.depth > 0"""
