"""Streams over the event files, run to the end, written to tables and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import tables as t
from checks.ingest import _FRESH, feature_rows, statistics
from checks.series import _ALERT, _LAG_NAMES, _LAGS, _RECORDS, _WINDOW, _cooldown, district_index, forecast_input
from checks.sql import AS_OF, QUALITY, SCORED, STAGING, WEATHER, WINDOWS, level, r, ts
from roadweave import fixed_values as fv
from roadweave.functions.numeric import rounded
from roadweave.functions.quality import with_quality
from roadweave.models import congestion, isolation_forest
from roadweave.plans import alerts, forecast
from roadweave.plans import features as plan_features
from roadweave.plans.warehouse import fact_rows
from roadweave.session import checkpoint_dir
from roadweave.sources import keyed
from roadweave.sources.tables import read_version
from roadweave.streaming import jobs, live, state, windows
from roadweave.streaming.asof import stream_asof_join

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


def folder(spark) -> str:
    """A new folder per run below the session's checkpoint folder."""
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def stored(spark, root, table):
    return spark.read.parquet(f"{root}/{table}").drop("event_date", "batch_id")


def finished(stream):
    stream.awaitTermination()


@query("t01_stream_road_windows", f"""with {WINDOWS}
select {ts('window_start')} as window_start, {ts('window_end')} as window_end, location_name, avg_speed, min_speed, max_speed,
  avg_free_flow_speed, avg_congestion_ratio, reading_count, closure_count from win where win.window_end <= (select max(request_time) from rd)""")
def stream_road_windows(spark, path):
    """Windows the stream has closed: the last one stays open until a later reading arrives."""
    root = folder(spark)
    found = windows.road_windows(t.reading_stream(spark, path), ts="request_time")
    finished(jobs.start(found, root, "traffic_aggregates", f"{root}/state", once=True))
    return stored(spark, root, "traffic_aggregates")


@query("t04_stream_warehouse", f"""with {STAGING}
select {ts('event_time')} as event_time, user_id % 25 + 1 as location_key, cast(hour * 7 + day_of_week + 1 as bigint) as time_key,
  cast(weather_key as bigint) as weather_key, current_speed, free_flow_speed, {r('congestion_ratio', 4)} as congestion_ratio,
  road_closure, confidence, temperature, rain_mm, cast(humidity as bigint) as humidity, wind_speed from stg""")
def stream_warehouse(spark, path):
    root = folder(spark)
    readings = t.reading_stream(spark, path).drop("event_type", "user_id")
    finished(jobs.load_warehouse(readings, lambda: t.dimensions(spark), root, f"{root}/state", once=True))
    return stored(spark, root, "fact_traffic").withColumn("congestion_ratio", rounded(F.col("congestion_ratio"), 4))


@query("t05_stream_lags", f"""with {SCORED}, lg as (select reading_id, location_name, least(row_number() over w, 145) as buffered, {_LAGS} from sc {_WINDOW})
select reading_id, location_name, buffered, buffered >= 144 as is_warm, {', '.join(r(c, 4) + ' as ' + c for c in _LAG_NAMES)} from lg""")
def stream_lags(spark, path):
    state.use_rocksdb(spark)
    root = folder(spark)
    readings = t.with_ratio(t.reading_stream(spark, path)).withColumn("event_time", F.col("request_time"))
    finished(jobs.start(state.stream_lags(readings), root, "road_lags", f"{root}/state", once=True))
    return stored(spark, root, "road_lags").select(
        "reading_id", "location_name", "buffered", "is_warm", *[rounded(F.col(c), 4).alias(c) for c in _LAG_NAMES])


@query("t07_stream_sent_alerts", f"{_cooldown(10 / 60)} select {_ALERT} from fin")
def stream_sent_alerts(spark, path):
    """Scored readings -> raised alerts -> sent alerts, through two streams."""
    state.use_rocksdb(spark)
    root = folder(spark)
    scored = t.scored_stream(spark, path)
    finished(jobs.raise_alerts(scored, root, f"{root}/raise", 3600, once=True))
    jobs.close_rounds(spark, root, scored.schema, 3600)
    finished(jobs.send_alerts(spark, root, f"{root}/send", once=True))
    return stored(spark, root, "alerts")


@query("t11_stream_latest_records", f"""with {_RECORDS} select location_name, current_speed, congestion_level, {r('congestion_ratio', 4)} as congestion_ratio,
  {ts('request_time')} as request_time, is_anomaly, {ts('first_seen')} as first_seen from la""")
def stream_latest_records(spark, path):
    """Upserts by road: a batch rewrites the buckets of its roads only."""
    root = folder(spark)
    columns = ["current_speed", "congestion_level", "congestion_ratio", "request_time", "is_anomaly"]
    table = keyed.KeyedTable(root, "latest_records", ["location_name"], "location_name string, reading_id bigint, current_speed double, "
                             "congestion_level string, congestion_ratio double, request_time timestamp, is_anomaly boolean, first_seen timestamp")

    def fold(new, held):
        new = new.withColumn("first_seen", F.col("request_time")).select("location_name", "reading_id", *columns, "first_seen")
        return new.unionByName(held).groupBy("location_name").agg(
            F.max_by(F.struct("reading_id", *columns), F.struct("request_time", "reading_id")).alias("n"), F.min("first_seen").alias("first_seen")).select(
            "location_name", "n.*", "first_seen")

    finished(jobs.upsert(t.scored_stream(spark, path), table, fold, f"{root}/state", once=True))
    found = table.read(spark, keyed.read_commit(spark, root)).drop("reading_id")
    return found.withColumn("congestion_ratio", rounded(F.col("congestion_ratio"), 4))


@query("t12_stream_quality_statistics", f"""with {QUALITY}, un as (select unnest(issues) as i from ql)
select 'total' as measure, count(*) as count from ql union all select 'passed', count(*) from ql where passed
union all select 'failed', count(*) from ql where not passed union all select 'warnings', count(*) from ql where passed and issues_count > 0
union all select 'fatal', count(*) from ql where fatal union all select concat('check:', i.check), count(*) from un group by i.check""")
def stream_quality_statistics(spark, path):
    root = folder(spark)
    checked = with_quality(t.message_stream(spark, path), F.col("arrived_at"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/statistics")

    finished(windows.quality_statistics(checked).writeStream.outputMode("complete")
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start())
    return spark.read.parquet(f"{root}/statistics")


# processing time is long after the events, so every readable time counts as stale
_NOW = QUALITY.replace("(epoch_us(arrived_at) - epoch_us(", "(epoch_us(timestamp '2100-01-01') - epoch_us(")


@query("t14_stream_fan_out", f"""with {_NOW}
select 'data_quality_events' as table_name, count(*) as rows from ql union all select 'fact_traffic', count(*) from ql where passed
union all select 'raw_events', count(*) from ql where passed
union all select concat('route:', case when not passed then 'fail' when quality_score < 80 and issues_count > 0 then 'warn' else 'pass' end), count(*) from ql group by 1""")
def stream_fan_out(spark, path):
    """One stream of defective messages into the quality log, the raw table and the warehouse."""
    root, dims = folder(spark), t.dimensions(spark)
    sinks = {
        "raw_events": lambda df: df.withColumn("request_time", F.try_to_timestamp("request_time")),
        "fact_traffic": lambda df: fact_rows(df, dims),
    }
    messages = t.message_stream(spark, path).drop("arrived_at")
    finished(jobs.fan_out(messages, root, f"{root}/state", sinks, once=True))
    counts = [stored(spark, root, n).select(F.lit(n).alias("table_name")) for n in ("data_quality_events", "fact_traffic", "raw_events")]
    routes = stored(spark, root, "data_quality_events").select(F.concat(F.lit("route:"), "route").alias("table_name"))
    every = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(routes)
    return every.groupBy("table_name").agg(F.count(F.lit(1)).alias("rows"))


# the clock stands after the last reading, so every readable time counts as stale
_LIVE = QUALITY.replace("(epoch_us(arrived_at) - epoch_us(", f"(epoch_us({AS_OF}) - epoch_us(")
_SPEED, _FREE = "coalesce(current_speed, 0)", "coalesce(free_flow_speed, 0)"


def _cents(x):
    return f"cast(round({x} * 100) as bigint)"


@query("t14_live_pipeline", f"""with {_LIVE}, gd as (select *, try_cast(nullif(request_time, '') as timestamp) as seen,
    {r(f'case when {_FREE} > 0 then {_SPEED} / {_FREE} else 0e0 end', 4)} as ratio from ql where passed),
 tm as (select *, row_number() over (partition by location_name order by seen, reading_id) as position from gd where seen is not null),
 lv as (select *, {level('ratio', 'road_closure')} as congestion_level from gd),
 wi as (select location_name, time_bucket(interval '5 minutes', seen) as w, {r(f'avg({_SPEED})', 2)} as s, {r(f'avg({_FREE})', 2)} as f, count(*) as n,
    count(*) filter (where road_closure) as c from tm group by all),
 hz(horizon, ahead) as (values ('20min', 20), ('30min', 30), ('60min', 60))
select 'data_quality_events' as table_name, cast(reading_id as varchar) as id, concat_ws(':', case when not passed then 'fail' when quality_score < 80 and issues_count > 0 then 'warn' else 'pass' end,
    quality_score, issues_count) as value from ql
union all select 'raw_events', cast(reading_id as varchar), concat_ws(':', current_travel_time, free_flow_travel_time) from gd
union all select 'fact_traffic', location_name, concat_ws(':', count(*), sum(weather_humid), {_cents(r('sum(current_speed)', 2))}) from gd group by location_name
union all select 'predictions', cast(reading_id as varchar), concat_ws(':', congestion_level, road_closure, 'known class') from lv
union all select 'anomalies', cast(reading_id as varchar), 'as in one batch' from gd
union all select 'forecasts', concat_ws('|', location_name, {ts('seen')}, horizon), concat_ws(':', {ts('seen + to_minutes(ahead)')}, count(*), 'as in one batch')
  from tm, hz where position > 144 group by location_name, seen, horizon, ahead
union all select 'traffic_aggregates', concat_ws('|', location_name, {ts('w')}), concat_ws(':', n, c, {_cents('s')}, {_cents('f')}) from wi
  where w + interval '5 minutes' <= (select max(seen) from tm)
union all select 'latest_records', location_name, concat_ws(':', max_by(reading_id, (seen, reading_id)), {ts('max(seen)')}, {ts('min(seen)')}) from tm group by location_name
union all select 'alerts', 'differences from one batch', '0'""")
def live_pipeline(spark, path):
    """One stream of defective messages through the whole pipeline with fitted models; every table's values.

    What models say is compared with the same models applied to all readings in one batch.
    """
    root, dims, clock = folder(spark), t.dimensions(spark), t.as_of()
    stats, plain = statistics(spark, path), t.readings(spark, path)
    feature_rows(spark, path, stats).write.parquet(f"{root}/models/training")
    training = spark.read.parquet(f"{root}/models/training")
    isolation_forest.train(training, "reading_id", trees=20).write.parquet(f"{root}/models/forest")
    for name, index in (("frc", plan_features.class_index(plain, "frc")), ("district", district_index(plain))):
        index.write.parquet(f"{root}/models/{name}")
    forecast_input(spark, path, ["road_closure", "position"], training).write.parquet(f"{root}/models/past")
    past = congestion.with_targets(spark.read.parquet(f"{root}/models/past"), placed=True)
    fitted = live.Models(
        spark.read.parquet(f"{root}/models/forest"), congestion.train_congestion(training, trees=5, depth=5), congestion.train_forecasts(past, trees=2, depth=3),
        stats, spark.read.parquet(f"{root}/models/frc"), spark.read.parquet(f"{root}/models/district"))
    settings = live.Settings(clock, 3600, sinks={
        "raw_events": lambda df: df.withColumn("request_time", F.try_to_timestamp("request_time")), "fact_traffic": lambda df: fact_rows(df, dims)})
    pipeline = live.Live(root, fitted, settings)
    finished(pipeline.start(t.message_stream(spark, path, 2).drop("arrived_at"), f"{root}/state", once=True))
    pipeline.finish(spark)

    checked = with_quality(t.spread_messages(spark, path).drop("arrived_at"), clock)
    live.scored(checked.filter("passed").drop("issues", "issues_count", "quality_score", "fatal", "passed"), fitted, clock).write.parquet(f"{root}/batch")
    batch = spark.read.parquet(f"{root}/batch")
    timed = batch.withColumn("request_time", F.try_to_timestamp("request_time")).filter("request_time IS NOT NULL")
    commit = keyed.read_commit(spark, root)
    seen = {name: keyed.committed(spark, root, name, commit).drop("event_date", "batch_id") for name in (*live.TABLES, *settings.sinks)}
    text = lambda *columns: F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")

    flags = seen["anomalies"].select(F.col("anomaly_id").alias("reading_id"), F.col("anomaly_score").alias("s"), F.col("reason"))
    agreed = batch.join(flags, "reading_id", "left").select(
        F.col("reading_id").alias("id"), F.when(F.col("is_anomaly").eqNullSafe(F.col("s").isNotNull()) & (~F.col("is_anomaly") | (
            F.col("s") == F.col("anomaly_score")) & (F.col("reason") == F.col("anomaly_reason"))), "as in one batch").otherwise("differs").alias("value"))
    ahead = forecast.forecast_table(congestion.predict_forecasts(fitted.forecasts, forecast.forecast_rows_from(
        timed, fitted.frc_index, fitted.district_index, readings=timed.select("location_name", "event_time"))))
    at = ["location_name", "forecast_made_at", "horizon", "target_time"]
    told = lambda df, name: df.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(
        "predicted_speed", "predicted_class", "confidence"))).alias(name))
    forecasts = told(seen["forecasts"], "a").join(told(ahead, "b"), at, "full").select(
        F.concat_ws("|", "location_name", stamp("forecast_made_at"), "horizon").alias("id"),
        F.concat_ws(":", stamp("target_time"), F.size("a").cast("string"), F.when(F.col("a") == F.col("b"), "as in one batch").otherwise("differs")).alias("value"))
    columns = ["alert_id", "triggered_at", "location_name", "alert_type", "message"]
    alerts.sent_alerts(timed, 3600).select(*columns).write.parquet(f"{root}/expected")
    expected = spark.read.parquet(f"{root}/expected")
    sent = seen["alerts"].select(*columns)
    apart = sent.exceptAll(expected).unionByName(expected.exceptAll(sent))
    found = {
        "data_quality_events": seen["data_quality_events"].select(
            F.get_json_object("raw_message", "$.reading_id").alias("id"), text("route", "quality_score", "issues_count").alias("value")),
        "raw_events": seen["raw_events"].select(F.col("reading_id").alias("id"), text("current_travel_time", "free_flow_travel_time").alias("value")),
        "fact_traffic": seen["fact_traffic"].join(dims["dim_location"], "location_key").groupBy(F.col("location_name").alias("id")).agg(
            F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("humidity").cast("string"),
                        F.round(rounded(F.sum("current_speed"), 2) * 100).cast("long").cast("string")).alias("value")),
        "predictions": seen["predictions"].join(batch.select("reading_id", "road_closure"), F.col("prediction_id") == F.col("reading_id")).select(
            F.col("prediction_id").alias("id"), F.concat_ws(":", "actual_congestion", (F.col("predicted_congestion") == "Closed").cast("string"), F.when(
                F.col("predicted_congestion").isin(fv.LEVELS), "known class").otherwise("unknown")).alias("value")),
        "anomalies": agreed,
        "forecasts": forecasts,
        "traffic_aggregates": seen["traffic_aggregates"].select(F.concat_ws("|", "location_name", stamp("window_start")).alias("id"), F.concat_ws(
            ":", F.col("reading_count").cast("string"), F.col("closure_count").cast("string"), cents("avg_speed"), cents("avg_free_flow_speed")).alias("value")),
        "latest_records": pipeline.latest.read(spark, commit).select(F.col("location_name").alias("id"), F.concat_ws(
            ":", F.col("reading_id").cast("string"), stamp("request_time"), stamp("first_seen")).alias("value")),
        "alerts": apart.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("differences from one batch").alias("id"), "value"),
    }
    parts = [df.select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"), "value") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query("j09_stream_weather", f"""with {WEATHER}, wm as (select least((select max(request_time) from rd), (select max(recorded_at) from we)) as until)
select rd.reading_id, {ts('rd.request_time')} as request_time, {_FRESH.format('temperature')} as temperature,
  {_FRESH.format('weather_main')} as condition, {_FRESH.format('rain_mm')} as rain_mm
from rd asof left join we w on rd.request_time >= w.recorded_at where rd.request_time < (select until - interval 1 hour from wm)""")
def stream_weather(spark, path):
    """Readings and weather as two streams; readings wait until both have passed them by an hour, as they come in no strict order."""
    state.use_rocksdb(spark)
    root = folder(spark)
    left = t.reading_stream(spark, path).select("reading_id", "request_time")
    right = t.as_weather(t.reading_stream(spark, path)).withColumnRenamed("weather_main", "condition")
    found = stream_asof_join(left, right, "request_time", "reading_id", "recorded_at", "weather_id", ["temperature", "condition", "rain_mm"], 1800, "1 hour", salts=2)
    finished(jobs.start(found, root, "raw_events", f"{root}/state", once=True))
    return stored(spark, root, "raw_events")


def _snapshots(readings):
    return t.with_ratio(readings).select(
        F.md5(F.concat_ws("|", "location_name", "congestion_level")).alias("snapshot_key"), F.col("request_time").alias("generated_at"),
        F.col("reading_id").alias("snapshot_id"))


_TEXTS = f"""with recursive {SCORED}, ix as (select md5(concat(location_name, '|', congestion_level)) as snapshot_key, request_time as made, min(reading_id) as id
  from sc group by 1, 2),
 kept as (select snapshot_key, min(made) as made from ix group by all
  union all select k.snapshot_key, (select min(ix.made) from ix where ix.snapshot_key = k.snapshot_key and ix.made >= k.made + interval 240 seconds) from kept k where k.made is not null)
select snapshot_key, {ts('made')} as generated_at, id as snapshot_id from kept join ix using (snapshot_key, made)"""


@query("t13_distinct_snapshots", _TEXTS)
def distinct_snapshots(spark, path):
    return windows.distinct_snapshots(_snapshots(t.readings(spark, path)))


@query("t13_stream_distinct_snapshots", _TEXTS)
def stream_distinct_snapshots(spark, path):
    """The same on a stream in several batches."""
    state.use_rocksdb(spark)
    root = folder(spark)
    found = windows.distinct_snapshots(_snapshots(t.reading_stream(spark, path)))
    finished(jobs.start(found, root, "ai_summaries", f"{root}/state", once=True))
    return stored(spark, root, "ai_summaries")
