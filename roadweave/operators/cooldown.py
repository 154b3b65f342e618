"""Suppression of repeated alerts: one key may alert again ``cooldown`` after its last *sent* alert.

Whether an alert is sent depends on the one sent before it, which makes a key's history a
chain.  To keep a key from running in one task, its time line is cut into blocks:

1. every block is summarised on its own as a step function "earliest allowed time when the
   block begins -> earliest allowed time when it ends";
2. the small functions of a key are applied one after the other;
3. every block is replayed from its now known starting point.

Steps 1 and 3 are spread by (key, block); step 2 sees a handful of numbers per block.  Alerts
of a key at the same instant are reduced to the first one beforehand, as the others can never
be sent.

A block that holds more than ``most_instants`` is halved, and its halves again, until every piece
holds fewer (or is 2^-16 of a block, where distinct microseconds bound it).  The functions of two
halves compose into that of the whole, level by level, up to the block; after step 2 the starting
points go down the same tree.  A function has at most one step per instant of its first cooldown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.session import checkpoint_dir

NEVER = -(1 << 62)
MOST_INSTANTS = 100_000
DEPTH = 16  # a block can be halved so often


def runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Cut sorted batches into runs of equal ``columns``; a run is never split.

    Yields a frame together with the positions at which its runs begin (and its length).
    """
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        new = np.zeros(len(whole), dtype=bool)
        new[0] = True
        for c in columns:
            values = whole[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        rest = whole.iloc[starts[-1]:].reset_index(drop=True)
        if len(starts) > 1:
            yield whole, [int(s) for s in starts]
    if rest is not None:
        yield rest, [0, len(rest)]


def _last_reached(times: np.ndarray, entries: int, cooldown: int) -> np.ndarray:
    """Position at which the chain from each of the first ``entries`` positions ends."""
    step, at = np.searchsorted(times, times + cooldown), np.arange(entries)
    moving = step[at] < len(times)
    while moving.any():
        at[moving] = step[at[moving]]
        moving = step[at] < len(times)
    return at


def _piece_start(block: int, node: int, block_micros: int) -> int:
    """Begin of a piece: nodes are numbered 1 for the block, 2n and 2n + 1 for the halves of n."""
    depth = int(node).bit_length() - 1
    return int(block) * block_micros + ((int(node) - (1 << depth)) * block_micros >> depth)


def _with_pieces(instants: DataFrame, slot: list[str], block: int, most: int) -> DataFrame:
    """``instants`` with the piece ``_node`` of their block they belong to."""
    cell = F.expr(f"(_t - _block * {block}L) * {1 << DEPTH}L div {block}L")
    hot = instants.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n")
    if hot.isEmpty():
        return instants.withColumn("_node", F.lit(1).cast("long"))
    celled = instants.withColumn("_cell", cell)
    ancestor = Window.partitionBy(*slot, "_depth", "_up")  # at most 2^16 cells each
    pieces = (
        celled.join(hot, slot, "left_semi").groupBy(*slot, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_depth", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
        .withColumn("_up", F.expr(f"shiftright(_cell, {DEPTH} - _depth)"))
        .withColumn("_all", F.sum("_n").over(ancestor))
        .groupBy(*slot, "_cell").agg(F.max(F.when(F.col("_all") > most, F.col("_depth"))).alias("_split"))
        .withColumn("_depth", F.least(F.col("_split") + 1, F.lit(DEPTH)))
        .select(*slot, "_cell", F.expr(f"shiftleft(1L, _depth) + shiftright(_cell, {DEPTH} - _depth)").alias("_node"))
    )
    return (
        celled.join(pieces, [*slot, "_cell"], "left")
        .withColumn("_node", F.coalesce("_node", F.lit(1).cast("long"))).drop("_cell").checkpoint()
    )


def suppress_repeats(
    alerts: DataFrame, keys: list[str], ts: str, tie: str, cooldown_seconds: int, block_seconds: int = 86_400,
    most_instants: int = MOST_INSTANTS,
) -> DataFrame:
    """The alerts that are sent.  ``tie`` is a unique id that orders alerts of one instant.

    The slim table of instants is checkpointed: it is read by two of the steps, and computing
    it may mean a pass over all readings.
    """
    checkpoint_dir(alerts.sparkSession)
    cooldown, block = cooldown_seconds * 1_000_000, block_seconds * 1_000_000
    slot = [*keys, "_block"]
    piece = [*slot, "_node"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.select(*keys).schema)
    step_types = f"{types}, _block bigint, _node bigint, _until bigint, _leave bigint"
    tie_type = alerts.schema[tie].dataType.simpleString()

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in runs(batches, piece):
            all_times, blocks, nodes = (frame[c].to_numpy() for c in ("_t", "_block", "_node"))
            rows, until, leave = [], [], []
            for begin, end in zip(starts, starts[1:]):
                times = all_times[begin:end]
                # a piece can be entered at any alert of its first cooldown span or the one after
                reach = np.searchsorted(times, _piece_start(blocks[begin], nodes[begin], block) + cooldown) + 1
                exits = times[_last_reached(times, min(reach, len(times)), cooldown)] + cooldown
                last_of_step = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
                rows += [begin] * len(last_of_step)
                until.append(times[last_of_step])
                leave.append(exits[last_of_step])
            yield frame.iloc[rows][piece].assign(_until=np.concatenate(until), _leave=np.concatenate(leave))

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in runs(batches, [*slot, "_up"]):
            blocks, nodes, whole, untils, leaves = (frame[c].to_numpy() for c in ("_block", "_node", "_up", "_until", "_leave"))
            rows, until, leave = [], [], []
            for begin, end in zip(starts, starts[1:]):
                cut = begin + np.searchsorted(nodes[begin:end], nodes[begin], side="right")
                exits, later = leaves[begin:end].copy(), untils[cut:end]
                step = np.searchsorted(later, exits[: cut - begin])
                inside = np.flatnonzero(step < len(later))
                exits[inside] = leaves[cut:end][step[inside]]
                reach = np.searchsorted(untils[begin:end], _piece_start(blocks[begin], whole[begin], block) + cooldown) + 1
                exits = exits[:reach]
                last_of_step = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
                rows += [begin] * len(last_of_step)
                until.append(untils[begin:end][last_of_step])
                leave.append(exits[last_of_step])
            made = frame.iloc[rows][[*slot, "_up"]].rename(columns={"_up": "_node"})
            yield made.assign(_until=np.concatenate(until), _leave=np.concatenate(leave))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in runs(batches, keys):
            blocks, until, leave = (frame[c].to_numpy() for c in ("_block", "_until", "_leave"))
            rows, begins = [], []
            for begin, end in zip(starts, starts[1:]):
                allowed, i = NEVER, begin
                while i < end:
                    rows.append(i)
                    begins.append(allowed)
                    after = i + np.searchsorted(blocks[i:end], blocks[i], side="right")
                    step = i + np.searchsorted(until[i:after], allowed)
                    allowed = int(leave[step]) if step < after else allowed
                    i = after
            yield frame.iloc[rows][slot].assign(_node=1, _allowed=begins)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in runs(batches, piece):
            all_times, allowed = frame["_t"].to_numpy(), frame["_allowed"].to_numpy()
            sent = []
            for begin, end in zip(starts, starts[1:]):
                times = all_times[begin:end]
                at = np.searchsorted(times, allowed[begin])
                while at < len(times):
                    sent.append(begin + at)
                    at = np.searchsorted(times, times[at] + cooldown)
            yield pd.DataFrame({tie: frame["_first"].to_numpy()[sent]})

    def at_depth(df: DataFrame, depth: int) -> DataFrame:
        return df.where(F.col("_node").between(1 << depth, (2 << depth) - 1))

    instants = (
        alerts.withColumn("_t", F.unix_micros(F.col(ts)))
        .withColumn("_block", F.floor(F.col("_t") / block))
        .groupBy(*slot, "_t").agg(F.min(tie).alias("_first"))
        .checkpoint()
    )
    instants = _with_pieces(instants, slot, block, most_instants)
    steps = (
        instants.select(*piece, "_t").repartition(*piece).sortWithinPartitions(*piece, "_t").mapInPandas(summarise, step_types)
    )
    deepest = (instants.agg(F.max("_node")).first()[0] or 1).bit_length() - 1
    if deepest:
        steps = steps.checkpoint()
    levels = {deepest: at_depth(steps, deepest)} if deepest else {0: steps}
    for depth in range(deepest - 1, -1, -1):
        composed = (
            levels[depth + 1].withColumn("_up", F.shiftright("_node", 1))
            .repartition(*slot, "_up").sortWithinPartitions(*slot, "_up", "_node", "_until").mapInPandas(compose, step_types)
        )
        levels[depth] = at_depth(steps, depth).unionByName(composed).checkpoint()
    starts = (
        levels[0].repartition(*keys).sortWithinPartitions(*slot, "_until")
        .mapInPandas(chain, f"{types}, _block bigint, _node bigint, _allowed bigint")
    )
    begun = starts
    for depth in range(deepest):
        parents = starts.select(*slot, F.col("_node").alias("_up"), "_allowed")
        halves = levels[depth + 1].withColumn("_up", F.shiftright("_node", 1))
        passed = (
            halves.where(F.col("_node") % 2 == 0).join(parents, [*slot, "_up"]).where(F.col("_until") >= F.col("_allowed"))
            .groupBy(*slot, "_up").agg(F.min_by("_leave", "_until").alias("_left"))
        )
        starts = (
            halves.select(*piece, "_up").distinct().join(parents, [*slot, "_up"]).join(passed, [*slot, "_up"], "left")
            .select(*piece, F.when(F.col("_node") % 2 == 1, F.coalesce("_left", "_allowed")).otherwise(F.col("_allowed")).alias("_allowed"))
            .checkpoint()
        )
        begun = begun.unionByName(starts)
    sent = (
        instants.join(begun, piece)
        .repartition(*piece).sortWithinPartitions(*piece, "_t")
        .mapInPandas(replay, f"`{tie}` {tie_type}")
    )
    return alerts.join(sent, tie, "left_semi")
