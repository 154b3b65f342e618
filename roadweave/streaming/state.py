"""Keyed state: lag buffers per road and alert cooldowns per (kind, road).

State lives in the state store of the stream's checkpoint, so it survives restarts and lost
executors.  Needs the RocksDB state store provider (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadweave import fixed_values as fv

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


BUFFER = "event_time timestamp, current_speed double, congestion_ratio double, road_closure boolean"
LAGS = [f"{value}_lag_{label}" for label in fv.LAG_ROWS for value in ("speed", "ratio")]
LAG_OUTPUT = ("location_name string, reading_id bigint, event_time timestamp, current_speed double, "
              "congestion_ratio double, " + ", ".join(f"{c} double" for c in LAGS) + ", buffered int, is_warm boolean")


class LagBuffer(StatefulProcessor):
    """The last readings of a road; every reading leaves with its lags."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", BUFFER)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        order = "position" if "position" in initialState else "event_time"
        held = initialState.sort_values(order, kind="stable").tail(fv.BUFFER_ROWS)
        self.rows.put([(r.event_time.to_pydatetime(), r.current_speed, r.congestion_ratio, bool(r.road_closure))
                       for r in held.itertuples()])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get()) if self.rows.exists() else []
        new = pd.concat(list(rows)).sort_values(["event_time", "reading_id"])
        fields = ["event_time", "current_speed", "congestion_ratio", "road_closure"]
        known = len(held)
        series = pd.concat([pd.DataFrame(held, columns=fields), new[fields]], ignore_index=True) if known else new[fields].reset_index(drop=True)
        out = new[["reading_id", "event_time", "current_speed", "congestion_ratio"]].reset_index(drop=True)
        out.insert(0, "location_name", key[0])
        for label, back in fv.LAG_ROWS.items():
            for value, column in (("speed", "current_speed"), ("ratio", "congestion_ratio")):
                out[f"{value}_lag_{label}"] = series[column].astype("float64").shift(back).iloc[known:].to_numpy()
        out["buffered"] = np.minimum(np.arange(known, known + len(new)) + 1, fv.BUFFER_ROWS)
        out["is_warm"] = out["buffered"] >= fv.WARM_ROWS
        kept = series.tail(fv.BUFFER_ROWS)
        self.rows.put([(t.to_pydatetime(), s, r, bool(c)) for t, s, r, c in
                       zip(kept["event_time"], kept["current_speed"], kept["congestion_ratio"], kept["road_closure"])])
        yield out.astype({c: "float64" for c in LAGS})

    def close(self) -> None:
        pass


def stream_lags(readings: DataFrame, backfill: DataFrame | None = None) -> DataFrame:
    """Lag features on a stream.

    ``backfill`` warms new state up: recent buffer records per road, or what ``buffer_snapshot`` saved of another stream.
    """
    needed = readings.select("location_name", "reading_id", "event_time", "current_speed", "congestion_ratio", "road_closure")
    initial = None if backfill is None else backfill.groupBy("location_name")
    return needed.groupBy("location_name").transformWithStateInPandas(
        statefulProcessor=LagBuffer(), outputStructType=LAG_OUTPUT, outputMode="Append", timeMode="None",
        initialState=initial)


def buffer_snapshot(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The buffers of all roads that a lag stream holds after ``batch`` (or its last one), each row with its place in the buffer.

    Read from the state store of the stream's checkpoint, partition by partition; the stream may be running. Stored as a
    table it starts a stream with a new checkpoint, also with another number of shuffle partitions, which a checkpoint fixes.
    """
    held = spark.read.format("statestore").options(stateVarName="rows", flattenCollectionTypes="false")
    held = held if batch is None else held.option("batchId", batch)
    return held.load(checkpoint).select("key.location_name", F.posexplode("list_value").alias("position", "held")).select(
        "location_name", "position", "held.*")


ALERT_OUTPUT = ("alert_id bigint, triggered_at timestamp, location_name string, kind string, severity string, "
                "alert_type string, message string")
ALERT_COLUMNS = [part.split()[0] for part in ALERT_OUTPUT.split(", ")]


class Cooldown(StatefulProcessor):
    """Event time of the last row kept for a key; forgotten after twice the cooldown."""

    def __init__(self, seconds: int, ts: str, order: list[str], columns: list[str]):
        self.seconds, self.ts, self.order, self.columns = seconds, ts, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_sent", "micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        new = pd.concat(list(rows)).sort_values(self.order)
        micros = new[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
        step, kept = self.seconds * 1_000_000, []
        at = 0 if last is None else int(np.searchsorted(micros, last + step))
        while at < len(micros):  # from each row kept to the first one after its silence
            kept.append(at)
            last = int(micros[at])
            at = max(at + 1, int(np.searchsorted(micros, last + step)))
        if kept:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + 2 * self.seconds * 1000)
        yield new.iloc[kept][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def stream_repeats(rows: DataFrame, keys: list[str], ts: str, tie: str, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Rows of a stream that come at least ``seconds`` after the last one kept for their key.

    The result does not depend on how the stream is cut into batches, as long as rows of a key arrive in time order
    from batch to batch.
    """
    processor = Cooldown(seconds, ts, [ts, tie], rows.columns)
    return rows.withWatermark(ts, lateness).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=rows.schema, outputMode="Append", timeMode="EventTime")


def stream_cooldown(alerts: DataFrame, seconds: int = fv.COOLDOWN_MINUTES * 60, lateness: str = "0 seconds") -> DataFrame:
    """Alerts that are sent, on a stream."""
    return stream_repeats(alerts.select(*ALERT_COLUMNS), ["kind", "location_name"], "triggered_at", "alert_id", seconds, lateness)
