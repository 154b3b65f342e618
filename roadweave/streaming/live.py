"""The whole live pipeline as one stream: quality, features, anomaly, class, forecast, windows, latest record, alerts.

Every micro-batch is checked and scored once; all tables are written under the batch's id and become visible together by one
commit record.  What later batches need (last rows of a road, open windows, newest record, last alert) is kept in tables
whose buckets a batch rewrites only where its roads fall into, so a batch costs what its rows cost, not what the city holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadweave import fixed_values as fv
from roadweave.functions import lookups
from roadweave.functions.numeric import rounded, safe_ratio
from roadweave.functions.quality import route, with_quality
from roadweave.functions.texts import anomaly_reason
from roadweave.models import congestion, isolation_forest
from roadweave.operators.cooldown import suppress_repeats
from roadweave.operators.latest import recent_per_key
from roadweave.plans import features as plan_features
from roadweave.plans.forecast import forecast_rows_from, forecast_table
from roadweave.sources.keyed import Commit, KeyedTable, read_commit, write_commit
from roadweave.sources.tables import read_version, replace_batch, write_version
from roadweave.streaming.jobs import RAISED, _evaluate
from roadweave.streaming.windows import LATEST_COLUMNS

TABLES = ["data_quality_events", "anomalies", "predictions", "forecasts", "traffic_aggregates", "alerts"]
BUFFER = ("location_name string, reading_id bigint, event_time timestamp, current_speed double, congestion_ratio double")
LATEST = ("location_name string, reading_id bigint, district string, current_speed double, congestion_level string, congestion_ratio double, "
          "speed_drop_pct double, weather_main string, rain_mm double, temperature double, request_time timestamp, is_anomaly boolean, first_seen timestamp")
SENT = "kind string, location_name string, last_sent timestamp"
WINDOWS = ("location_name string, window_start timestamp, speed_sum double, speeds bigint, min_speed double, max_speed double, "
           "free_flow_sum double, free_flows bigint, reading_count bigint, closure_count bigint")


@dataclass
class Models:
    """Fitted models and the small tables features are looked up in; loaded once, used by every batch."""

    forest: DataFrame
    congestion: PipelineModel
    forecasts: dict
    stats: DataFrame
    frc_index: DataFrame
    district_index: DataFrame


@dataclass
class Settings:
    clock: Column = field(default_factory=F.current_timestamp)
    round_seconds: int | None = None
    cooldown_seconds: int = fv.COOLDOWN_MINUTES * 60
    window: str = "5 minutes"
    lateness_seconds: int = 0
    sinks: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    """More tables of the readings that pass: name -> builder."""


def scored(good: DataFrame, models: Models, clock: Column) -> DataFrame:
    """Readings that passed -> features, anomaly verdict with its reason, actual and predicted class."""
    rows = plan_features.traffic_features(good, models.stats, models.frc_index, clock)
    rows = isolation_forest.score(rows, models.forest)
    flag = isolation_forest.is_anomaly(F.col("anomaly_score"), F.col("road_closure"), F.col("speed_drop_pct"))
    reason = anomaly_reason(F.col("road_closure"), F.col("speed_drop_pct"), F.col("speed_deviation"), F.col("rain_mm"), F.col("anomaly_score"))
    rows = congestion.predict_congestion(models.congestion, rows.withColumn("anomaly_score", rounded(F.col("anomaly_score"), 4)))
    return rows.withColumn("is_anomaly", F.coalesce(flag, F.lit(False))).withColumn("anomaly_reason", F.when(F.col("is_anomaly"), reason))


def quality_events(checked: DataFrame, columns: list[str]) -> DataFrame:
    return checked.select("checked_at", "location_name", "quality_score", "passed", "issues_count", "issues", "route",
                          F.to_json(F.struct(*columns)).alias("raw_message"))


def anomaly_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("is_anomaly").select(
        F.col("reading_id").alias("anomaly_id"), F.col("event_time").alias("detected_at"), "location_name", "anomaly_score", "current_speed",
        "free_flow_speed", "congestion_ratio", F.col("anomaly_reason").alias("reason"))


def prediction_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("reading_id").alias("prediction_id"), F.col("event_time").alias("predicted_at"), "location_name",
                       "predicted_congestion", "actual_congestion", "confidence")


def partial_windows(rows: DataFrame, size: str) -> DataFrame:
    """Sums of the readings of each road and window, in a form that adds up over batches."""
    return rows.groupBy("location_name", F.window("event_time", size)["start"].alias("window_start")).agg(
        F.sum("current_speed").alias("speed_sum"), F.count("current_speed").alias("speeds"), F.min("current_speed").alias("min_speed"),
        F.max("current_speed").alias("max_speed"), F.sum("free_flow_speed").alias("free_flow_sum"), F.count("free_flow_speed").alias("free_flows"),
        F.count(F.lit(1)).alias("reading_count"), F.count_if("road_closure").alias("closure_count"))


def merged_windows(partials: DataFrame) -> DataFrame:
    return partials.groupBy("location_name", "window_start").agg(
        *[getattr(F, how)(c).alias(c) for c, how in (("speed_sum", "sum"), ("speeds", "sum"), ("min_speed", "min"), ("max_speed", "max"),
                                                     ("free_flow_sum", "sum"), ("free_flows", "sum"), ("reading_count", "sum"), ("closure_count", "sum"))])


def window_rows(closed: DataFrame, size: str) -> DataFrame:
    """Windows as they are stored; one without any speed gives no row."""
    speed, free_flow = F.col("speed_sum") / F.col("speeds"), F.coalesce(F.try_divide("free_flow_sum", "free_flows"), F.lit(0.0))
    return closed.filter("speeds > 0").select(
        "window_start", (F.col("window_start") + F.expr(f"INTERVAL {size}")).alias("window_end"), "location_name",
        rounded(speed, 2).alias("avg_speed"), rounded(F.col("min_speed"), 2).alias("min_speed"), rounded(F.col("max_speed"), 2).alias("max_speed"),
        rounded(free_flow, 2).alias("avg_free_flow_speed"), rounded(safe_ratio(speed, free_flow), 4).alias("avg_congestion_ratio"),
        "reading_count", "closure_count")


def newest_records(rows: DataFrame) -> DataFrame:
    """One row per road: the newest by time and id, with the time the road was first seen."""
    return rows.groupBy("location_name").agg(
        F.max_by(F.struct("reading_id", *LATEST_COLUMNS), F.struct("request_time", "reading_id")).alias("newest"),
        F.min("first_seen").alias("first_seen")).select("location_name", "newest.*", "first_seen")


class Live:
    """One stream's tables and the work of a micro-batch."""

    def __init__(self, root: str, models: Models, settings: Settings | None = None):
        self.root, self.models, self.settings = root, models, settings or Settings()
        self.buffers = KeyedTable(root, "road_buffers", ["location_name"], BUFFER)
        self.latest = KeyedTable(root, "latest_records", ["location_name"], LATEST)
        self.last_sent = KeyedTable(root, "last_sent", ["kind", "location_name"], SENT)

    def start(self, readings: DataFrame, checkpoint: str, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
        writer = readings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.write)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Everything a batch adds.  Nothing is visible before the commit at the end; a repeated batch replaces what it left."""
        spark, set_, root = batch.sparkSession, self.settings, self.root
        before = read_commit(spark, root, batch_id - 1)
        commit = before.following(batch_id)
        checked = with_quality(batch, set_.clock).withColumn("checked_at", set_.clock)
        checked = checked.withColumn("route", route(F.col("quality_score"), F.col("passed"), F.col("issues_count"))).persist(StorageLevel.MEMORY_AND_DISK)
        good = checked.filter("route <> 'fail'").select(*batch.columns)
        rows = scored(good, self.models, set_.clock).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            replace_batch(quality_events(checked, batch.columns), root, "data_quality_events", batch_id)
            for table, build in set_.sinks.items():
                replace_batch(build(good), root, table, batch_id)
            replace_batch(anomaly_rows(rows), root, "anomalies", batch_id)
            replace_batch(prediction_rows(rows), root, "predictions", batch_id)
            # what depends on time order leaves out readings without a readable time
            timed = rows.withColumn("request_time", lookups.instant(rows, "request_time")).filter("request_time IS NOT NULL")
            self._forecasts(timed, before, commit)
            self._windows(timed, before, commit)
            self._latest(timed, before, commit)
            self._alerts(timed, before, commit)
            write_commit(spark, root, commit, before)
        finally:
            rows.unpersist()
            checked.unpersist()

    def _forecasts(self, rows: DataFrame, before: Commit, commit: Commit) -> None:
        touched = self.buffers.touched(rows)
        held = self.buffers.read(rows.sparkSession, before, touched)
        series = rows.withColumn("is_new", F.lit(True)).unionByName(held.withColumn("is_new", F.lit(False)), allowMissingColumns=True)
        counted = series.select("location_name", "event_time")
        found = forecast_rows_from(series, self.models.frc_index, self.models.district_index, ["is_new"], counted).filter("is_new")
        forecasts = forecast_table(congestion.predict_forecasts(self.models.forecasts, found.drop("is_new")))
        replace_batch(forecasts, self.root, "forecasts", commit.batch)
        names = [c.split()[0] for c in BUFFER.split(", ")]
        kept = recent_per_key(series.select(*names), ["location_name"], ["event_time", "reading_id"], fv.BUFFER_ROWS)
        self.buffers.write(kept.select(*names), touched, commit)

    def _windows(self, rows: DataFrame, before: Commit, commit: Commit) -> None:
        """Windows close when event time passes their end; later rows for them are dropped."""
        spark, set_ = rows.sparkSession, self.settings
        late = F.make_interval(secs=F.lit(set_.lateness_seconds))
        newest = rows.agg((F.max("event_time") - late).cast("string").alias("t")).first()["t"]
        earlier = before.notes.get("window_bound")
        bound = max((b for b in (newest, earlier) if b), default=None)
        end = F.col("window_start") + F.expr(f"INTERVAL {set_.window}")
        new = partial_windows(rows.filter("location_name <> ''"), set_.window)
        new = new.filter(end > F.lit(earlier).cast("timestamp")) if earlier else new
        every = merged_windows(read_version(spark, self.root, "open_windows", WINDOWS, commit.batch - 1).unionByName(new))
        every = every.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            closed = end <= F.lit(bound).cast("timestamp") if bound else F.lit(False)
            replace_batch(window_rows(every.filter(closed), set_.window), self.root, "traffic_aggregates", commit.batch)
            write_version(every.filter(~closed), self.root, "open_windows", commit.batch)
        finally:
            every.unpersist()
        if bound:
            commit.notes["window_bound"] = bound

    def _latest(self, rows: DataFrame, before: Commit, commit: Commit) -> None:
        touched = self.latest.touched(rows)
        new = rows.filter("location_name <> ''").withColumn("congestion_level", F.col("predicted_congestion")).withColumn("first_seen", F.col("request_time"))
        names = ["location_name", "reading_id", *LATEST_COLUMNS, "first_seen"]
        held = self.latest.read(rows.sparkSession, before, touched)
        self.latest.write(newest_records(new.select(*names).unionByName(held.select(*names))), touched, commit)

    def _alerts(self, rows: DataFrame, before: Commit, commit: Commit, close_all: bool = False) -> None:
        """Raised alerts of complete rounds, then those that come after the silence of their kind and road."""
        spark, set_ = rows.sparkSession, self.settings
        columns = ["reading_id", "request_time", "location_name", "predicted_congestion", "is_anomaly", "anomaly_score", "anomaly_reason",
                   "is_rush_hour", "hour", "road_closure", "current_speed", "free_flow_speed"]
        # the end of the stream is a batch of its own: it goes on from the rounds that the last batch left open
        _evaluate(rows.select(*columns), self.root, commit.batch - close_all, set_.round_seconds, set_.lateness_seconds, close_all)
        part = -commit.batch if close_all else commit.batch
        raised = spark.read.schema(RAISED).parquet(f"{self.root}/raised_alerts").filter(F.col("batch_id") == part).drop("event_date", "batch_id")
        touched = self.last_sent.touched(raised)
        last = self.last_sent.read(spark, before, touched)
        due = raised.join(last, ["kind", "location_name"], "left").filter(
            F.col("last_sent").isNull() | (F.col("triggered_at") >= F.col("last_sent") + F.make_interval(secs=F.lit(set_.cooldown_seconds)))).drop("last_sent")
        sent = suppress_repeats(due, ["kind", "location_name"], "triggered_at", "alert_id", set_.cooldown_seconds).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            replace_batch(sent, self.root, "alerts", commit.batch)
            newest = last.unionByName(sent.select("kind", "location_name", F.col("triggered_at").alias("last_sent")))
            self.last_sent.write(newest.groupBy("kind", "location_name").agg(F.max("last_sent").alias("last_sent")), touched, commit)
        finally:
            sent.unpersist()

    def finish(self, spark: SparkSession) -> None:
        """End of the stream: evaluate the rounds still open, under the number after the last batch.

        Windows that event time has not passed stay open.
        """
        before = read_commit(spark, self.root)
        commit = before.following(before.batch + 1)
        held = read_version(spark, self.root, "open_readings")
        self._alerts(held.limit(0), before, commit, close_all=True)
        write_commit(spark, self.root, commit, before)
