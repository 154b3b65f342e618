"""Windowed and keyed aggregates; each builder works on a stream and on a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import rounded, safe_ratio
from roadweave.operators.cooldown import suppress_repeats
from roadweave.streaming.state import stream_repeats


def road_windows(readings: DataFrame, ts: str = "event_time", size: str = "5 minutes",
                 lateness: str = "0 seconds") -> DataFrame:
    """Five-minute aggregates per road.

    A window closes when the event time passes its end plus ``lateness``; later rows for it
    are dropped.  The mean ratio is the ratio of the means.  A window without any speed gives
    no row, but rows without a speed count as readings.
    """
    if readings.isStreaming:
        readings = readings.withWatermark(ts, lateness)
    speed, free_flow = F.avg("current_speed"), F.coalesce(F.avg("free_flow_speed"), F.lit(0.0))
    return (
        readings.filter(F.col(ts).isNotNull() & (F.coalesce("location_name", F.lit("")) != ""))
        .groupBy(F.window(ts, size).alias("window"), "location_name")
        .agg(
            rounded(speed, 2).alias("avg_speed"), rounded(F.min("current_speed"), 2).alias("min_speed"),
            rounded(F.max("current_speed"), 2).alias("max_speed"), rounded(free_flow, 2).alias("avg_free_flow_speed"),
            rounded(safe_ratio(speed, free_flow), 4).alias("avg_congestion_ratio"),
            F.count(F.lit(1)).alias("reading_count"), F.count_if("road_closure").alias("closure_count"),
            F.count("current_speed").alias("_speeds"),
        )
        .filter(F.col("_speeds") > 0)
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "location_name", "avg_speed", "min_speed", "max_speed", "avg_free_flow_speed",
                "avg_congestion_ratio", "reading_count", "closure_count")
    )


LATEST_COLUMNS = [
    "district", "current_speed", "congestion_level", "congestion_ratio", "speed_drop_pct", "weather_main",
    "rain_mm", "temperature", "request_time", "is_anomaly",
]


def latest_records(scored: DataFrame, newest_by: list[str], columns: list[str] | None = None) -> DataFrame:
    """Newest record per road plus when the road was first seen (update or complete mode on a stream)."""
    return (
        scored.filter(F.coalesce("location_name", F.lit("")) != "")
        .groupBy("location_name")
        .agg(F.max_by(F.struct(*(columns or LATEST_COLUMNS)), F.struct(*newest_by)).alias("newest"),
             F.min(newest_by[0]).alias("first_seen"))
        .select("location_name", "newest.*", "first_seen")
    )


def quality_statistics(checked: DataFrame) -> DataFrame:
    """Running totals plus a count per check, as one row per measure (update or complete mode)."""
    ok = F.col("passed")
    measures = F.array_compact(F.concat(
        F.array(F.lit("total"), F.when(ok, F.lit("passed")), F.when(~ok, F.lit("failed")),
                F.when(ok & (F.col("issues_count") > 0), F.lit("warnings")), F.when(F.col("fatal"), F.lit("fatal"))),
        F.transform("issues", lambda i: F.concat(F.lit("check:"), i["check"]))))
    return checked.select(F.explode(measures).alias("measure")).groupBy("measure").agg(
        F.count(F.lit(1)).alias("count"))


def distinct_snapshots(snapshots: DataFrame, ts: str = "generated_at", seconds: int = fv.SNAPSHOT_CACHE_SECONDS,
                       lateness: str = "0 seconds", tie: str = "snapshot_id") -> DataFrame:
    """Snapshots that need a new text: none was made for their key within the last ``seconds``.

    A text is used again while it is younger than ``seconds``; its age counts from when it was made, not from its last use.
    ``tie`` is a unique id.
    """
    if snapshots.isStreaming:
        return stream_repeats(snapshots, ["snapshot_key"], ts, tie, seconds, lateness)
    return suppress_repeats(snapshots, ["snapshot_key"], ts, tie, seconds)
