"""As-of join of two streams: each left row takes the newest right row at or before it, within a tolerance.

Left rows wait in keyed state until event time, on both inputs, has passed them: only then no earlier right row can come
any more.  Time is cut into slots as long as the tolerance; a right row is kept for its own slot and the next one, so slots
are independent, and slots are cut further by a salt, for which right rows are repeated.  A series of one city thus
spreads over tasks, and state is forgotten slot by slot.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadweave.operators.sizing import salt_of

LEFT, RIGHT = 0, 1
HELD = "micros bigint, tie bigint, text string"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class AsOf(StatefulProcessor):
    """Left rows that wait and right rows that may still be asked for, of one slot."""

    def __init__(self, tolerance_seconds: int, slot_place: int, names: list[str]):
        self.micros, self.slot_place, self.names = tolerance_seconds * 1_000_000, slot_place, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.rights = handle.getListState("waiting", HELD), handle.getListState("rights", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame.columns = self.names  # of a union, Spark hands over the columns without their names
            micros = frame["_at"].astype("datetime64[us]").astype("int64")
            for kind, state in ((LEFT, self.waiting), (RIGHT, self.rights)):
                mine = frame["_kind"] == kind
                new = list(zip(micros[mine].tolist(), frame["_tie"][mine].tolist(), frame["_text"][mine].tolist()))
                if new:
                    state.appendList(new)
        yield self._due(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._due(key, timerValues)

    def _due(self, key, timerValues) -> pd.DataFrame:
        """Answer the rows that event time has passed; wake up again for the next one, or to forget the slot."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rights = sorted(tuple(r) for r in self.rights.get()) if self.rights.exists() else []
        instants = [r[0] for r in rights]
        lefts, found = [], []
        for micros, _, text in held:
            if micros < passed:
                at = bisect_right(instants, micros) - 1
                lefts.append(text)
                found.append(rights[at][2] if at >= 0 and micros - instants[at] <= self.micros else None)
        rest = [r for r in held if r[0] >= passed]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = (key[self.slot_place] + 1) * self.micros
        if rest or passed < end:
            # later than now: a timer of the instant that is just firing would go with it
            self.handle.registerTimer(max(min([r[0] for r in rest], default=end), passed + 1000) // 1000)
            self.waiting.put(rest) if rest else self.waiting.clear()
            # of the right rows that are passed only the newest can still be an answer
            kept = rights[max(bisect_right(instants, passed) - 1, 0):]
            self.rights.put(kept) if kept else self.rights.clear()
        else:
            self.waiting.clear()
            self.rights.clear()
        return pd.DataFrame({"_left": pd.Series(lefts, dtype=object), "_found": pd.Series(found, dtype=object)})

    def close(self) -> None:
        pass


def stream_asof_join(left: DataFrame, right: DataFrame, left_ts: str, left_id: str, right_ts: str, right_id: str, columns: list[str],
                     tolerance_seconds: int, lateness: str = "0 seconds", by: list[str] | None = None, salts: int = 8) -> DataFrame:
    """Left rows plus ``columns`` of the matched right row (NULL without a match), as ``asof_join`` gives them for tables.

    A row may come ``lateness`` after later ones of its input; rows later than that are dropped.  Of right rows of
    one instant the one of the greatest id counts.
    """
    by = by or []
    kept = [f for f in left.schema if f.name not in columns]
    wanted = right.select(*columns).schema

    def side(df, ts, tie, kind, text, slots, salt):
        rows = df.filter(F.col(ts).isNotNull()).withWatermark(ts, lateness)
        slot = F.floor(F.unix_micros(ts) / (tolerance_seconds * 1_000_000))
        return rows.select(*by, F.col(ts).alias("_at"), F.lit(kind).alias("_kind"), F.col(tie).cast("long").alias("_tie"),
                           F.to_json(text, TIMES).alias("_text"), F.explode(slots(slot)).alias("_slot"), salt.alias("_salt"))

    lefts = side(left, left_ts, left_id, LEFT, F.struct(*[f.name for f in kept]), lambda s: F.array(s), salt_of(F.col(left_id), F.lit(salts)))
    rights = side(right, right_ts, right_id, RIGHT, F.struct(*columns), lambda s: F.array(s, s + 1), F.lit(0))
    rights = rights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [*by, "_slot", "_salt"]
    every = lefts.unionByName(rights)
    found = every.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=AsOf(tolerance_seconds, len(by), every.columns), outputStructType="_left string, _found string", outputMode="Append", timeMode="EventTime")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    answer = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted)
    return found.select(F.from_json("_left", kind, TIMES).alias("l"), F.from_json("_found", answer, TIMES).alias("f")).select("l.*", "f.*")
