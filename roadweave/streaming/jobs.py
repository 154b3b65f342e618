"""Streaming jobs: warehouse load and the fan-out of one reading stream into all tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from roadweave import fixed_values as fv
from roadweave.functions.quality import route, with_quality
from roadweave.plans import alerts
from roadweave.plans.warehouse import fact_rows
from roadweave.sources.keyed import KeyedTable, read_commit, write_commit
from roadweave.sources.tables import read_version, replace_batch, versions, write_version
from roadweave.streaming.state import stream_cooldown

# columns of a raised alert, in the order they are stored
RAISED = ("alert_id bigint, triggered_at timestamp, location_name string, kind string, severity string, "
          "alert_type string, message string, event_date date, batch_id int")
CLOSED = "location_name string, round_start timestamp"


def start(df: DataFrame, root: str, table: str, checkpoint: str, mode: str = "append",
          once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Write a stream into a table, batch by batch, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_batch(batch, root, table, batch_id)

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def load_warehouse(readings: DataFrame, dimensions: Callable[[], dict[str, DataFrame]], root: str, checkpoint: str,
                   once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Reading stream -> fact table.  ``dimensions`` is called for every batch, so new dimension rows count."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_batch(fact_rows(batch, dimensions()), root, "fact_traffic", batch_id)

    writer = readings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def fan_out(
    readings: DataFrame, root: str, checkpoint: str,
    sinks: dict[str, Callable[[DataFrame], DataFrame]],
    once: bool = False, every: str = "30 seconds",
) -> StreamingQuery:
    """One reading stream, many tables.

    Each batch is checked for quality once and kept (spilling to disk) while the sinks run:
    all results go to ``data_quality_events``; readings that passed go to every sink
    ``table -> builder``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = with_quality(batch, F.current_timestamp()).withColumn("checked_at", F.current_timestamp())
        checked = checked.withColumn("route", route(F.col("quality_score"), F.col("passed"), F.col("issues_count")))
        checked.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            events = checked.select(
                "checked_at", "location_name", "quality_score", "passed", "issues_count", "issues", "route",
                F.to_json(F.struct(*batch.columns)).alias("raw_message"))
            replace_batch(events, root, "data_quality_events", batch_id)
            good = checked.filter(F.col("route") != "fail").select(*batch.columns)
            for table, build in sinks.items():
                replace_batch(build(good), root, table, batch_id)
        finally:
            checked.unpersist()

    writer = readings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def keep_latest(newest: DataFrame, root: str, table: str, checkpoint: str, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """A complete-mode aggregate -> a table with one current version; ``read_version`` reads it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, root, table, batch_id)

    writer = newest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def upsert(stream: DataFrame, table: KeyedTable, fold: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str,
           once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """A stream of rows -> a keyed table, by ``fold(new rows, rows held for their buckets)``.

    A batch reads and rewrites the buckets its keys fall into; files of the others stay as they are.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_commit(spark, table.root, batch_id - 1)
        commit = before.following(batch_id)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = table.touched(batch)
            table.write(fold(batch, table.read(spark, before, touched)), touched, commit)
        finally:
            batch.unpersist()
        write_commit(spark, table.root, commit, before)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _evaluate(rows: DataFrame, root: str, batch_id: int, seconds: int | None, lateness_seconds: int, close_all: bool) -> None:
    """Raise what `rows` (this batch) and the readings held back so far allow; hold back the open rounds."""
    spark = rows.sparkSession
    # a batch has an even version; one after it may stand for the end of the stream
    version = 2 * batch_id + close_all
    before = version - 1
    held = read_version(spark, root, "open_readings", rows.schema, before)
    known = read_version(spark, root, "closed_rounds", CLOSED, before)
    bounds = read_version(spark, root, "round_bound", "bound timestamp", before)
    earlier = bounds.first()
    earlier = earlier["bound"] if earlier else None
    every = alerts.with_round(rows.withColumn("_new", F.lit(True)).unionByName(held.withColumn("_new", F.lit(False))), seconds)
    every = every.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        newest = every.agg(F.max("request_time").alias("t")).select(
            alerts.round_start(F.col("t") - F.make_interval(secs=F.lit(lateness_seconds)), seconds).alias("t")).first()["t"]
        bound = max((b for b in (newest, earlier) if b is not None), default=None)
        late = F.col("_new") & (F.col("round_start") < F.lit(earlier)) if earlier else F.lit(False)
        done = F.lit(True) if close_all else F.col("round_start") < F.lit(bound) if bound else F.lit(False)
        plain = every.columns[: len(rows.columns)]
        complete = every.filter(done & ~late).select(*plain)
        new = every.filter("_new").select(*plain)
        raised = alerts.reading_alerts(new).unionByName(alerts.round_alerts(complete, seconds, known))
        part = -batch_id - 1 if close_all else batch_id
        replace_batch(raised, root, "raised_alerts", part)
        replace_batch(every.filter(late).select(*plain), root, "late_readings", part)
        closed = alerts.closed_rounds(alerts.with_round(complete, seconds)).unionByName(known)
        if bound:
            closed = closed.filter(F.col("round_start") >= alerts.previous_round(F.lit(bound), seconds))
        write_version(closed, root, "closed_rounds", version)
        write_version(spark.createDataFrame([(bound,)] if bound else [], "bound timestamp"), root, "round_bound", version)
        write_version(every.filter(~done & ~late).select(*plain), root, "open_readings", version)
    finally:
        every.unpersist()


def raise_alerts(scored: DataFrame, root: str, checkpoint: str, round_seconds: int | None = None,
                 lateness_seconds: int = 0, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Scored reading stream -> ``raised_alerts``.

    Anomaly and congestion alerts leave at once.  Closure and city alerts need whole rounds: readings are held in
    ``open_readings`` until event time is ``lateness_seconds`` past their round, however the stream is cut into
    batches.  Readings of rounds already evaluated go to ``late_readings``.  State is a version per batch, so a
    repeated batch starts from the version before it.  ``close_rounds`` evaluates what is held when a stream ends.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _evaluate(batch, root, batch_id, round_seconds, lateness_seconds, False)

    writer = scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def close_rounds(spark: SparkSession, root: str, schema: StructType, round_seconds: int | None = None) -> None:
    """Evaluate the rounds still open at the end of a stream of ``schema``."""
    known = versions(spark, root, "open_readings")
    if known:
        _evaluate(spark.createDataFrame([], schema), root, known[-1] // 2, round_seconds, 0, True)


def send_alerts(spark, root: str, checkpoint: str, cooldown_seconds: int = fv.COOLDOWN_MINUTES * 60,
                lateness: str = "10 minutes", once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """``raised_alerts`` as a stream -> ``alerts``, with repeats suppressed by keyed state."""
    raised = spark.readStream.schema(RAISED).parquet(f"{root}/raised_alerts")
    return start(stream_cooldown(raised, cooldown_seconds, lateness), root, "alerts", checkpoint, once=once, every=every)
