"""Streams in several batches give what the batch operators give."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import tables as t
from roadweave import fixed_values as fv
from roadweave.plans import alerts, forecast
from roadweave.session import checkpoint_dir
from roadweave.sources import tables
from roadweave.streaming import jobs, state, windows

READING = ("reading_id long, event_time timestamp, location_name string, current_speed double, free_flow_speed double, "
           "congestion_ratio double, road_closure boolean")
START = datetime(2024, 1, 1)


@pytest.fixture
def root(spark):
    state.use_rocksdb(spark)
    return f"{checkpoint_dir(spark)}/tests/{uuid.uuid4().hex}"


def reading(i, minutes, road="A", speed=30.0):
    return (i, START + timedelta(minutes=minutes), road, speed, 60.0, None if speed is None else speed / 60, i % 5 == 0)


def feed(spark, root, rows, schema=READING):
    """Add one file; a stream with one file per trigger takes it as one batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")


def stream(spark, root, schema=READING):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def rows_of(spark, root, table):
    return spark.read.parquet(f"{root}/{table}").drop("event_date", "batch_id")


def run(df, root, table, **options):
    jobs.start(df, root, table, f"{root}/state_{table}", once=True, **options).awaitTermination()


def test_windows_close_by_event_time_and_late_rows_are_dropped(spark, root):
    feed(spark, root, [reading(1, 0, speed=20.0), reading(2, 4, speed=None), reading(3, 4.5, speed=40.0), reading(4, 2, "B", None)])
    run(windows.road_windows(stream(spark, root)), root, "traffic_aggregates")
    feed(spark, root, [reading(5, 11)])
    run(windows.road_windows(stream(spark, root)), root, "traffic_aggregates")
    feed(spark, root, [reading(6, 1, speed=99.0), reading(7, 30)])
    run(windows.road_windows(stream(spark, root)), root, "traffic_aggregates")
    got = {(r["location_name"], r["window_start"].minute): r for r in rows_of(spark, root, "traffic_aggregates").collect()}
    assert set(got) == {("A", 0), ("A", 10)}
    first = got[("A", 0)]
    assert (first["reading_count"], first["avg_speed"], first["avg_congestion_ratio"], first["max_speed"]) == (3, 30.0, 0.5, 40.0)


def test_lag_state_survives_restarts_and_equals_the_batch(spark, root):
    rows = [reading(i, i * 10, "AB"[i % 2], float(i)) for i in range(320)]
    for part in (rows[:7], rows[7:200], rows[200:]):
        feed(spark, root, part)
        run(state.stream_lags(stream(spark, root)), root, "road_lags")
    got = {r["reading_id"]: r for r in rows_of(spark, root, "road_lags").collect()}
    table = spark.createDataFrame(rows, READING)
    for r in forecast.lag_features(table, ts="event_time").collect():
        line = got[r["reading_id"]]
        assert [line[c] for c in state.LAGS] == [r[c] for c in state.LAGS]
        assert line["buffered"] == min(r["position"], 145) and line["is_warm"] == (r["position"] >= 144)
    # warm is reached one row before the longest lag exists
    at_144 = [r for r in got.values() if r["buffered"] == 144][0]
    assert at_144["is_warm"] and at_144["speed_lag_1day"] is None


def test_backfill_warms_new_state(spark, root):
    past = spark.createDataFrame([reading(i, i * 10, "A", float(i)) for i in range(150)], READING)
    backfill = past.select("location_name", "event_time", "current_speed", "congestion_ratio", "road_closure")
    feed(spark, root, [reading(900, 2000, "A", 500.0), reading(901, 2000, "B", 1.0)])
    run(state.stream_lags(stream(spark, root), backfill), root, "road_lags")
    got = {r["location_name"]: r for r in rows_of(spark, root, "road_lags").collect()}
    assert got["A"]["is_warm"] and got["A"]["speed_lag_10min"] == 149.0 and got["A"]["speed_lag_1day"] == 6.0
    assert not got["B"]["is_warm"] and got["B"]["speed_lag_10min"] is None


ALERT = state.ALERT_OUTPUT


def alert(i, minutes, severity="info"):
    return (i, START + timedelta(minutes=minutes), "A", "K", severity, f"{severity}:K", "m")


def test_buffers_saved_and_moved_to_a_stream_of_another_width(spark, root):
    """Equal times keep their order; the snapshot of an earlier batch can be read too."""
    rows = [reading(i, i // 3, "AB"[i % 2], float(i)) for i in range(400)]
    feed(spark, root, rows[:150])
    run(state.stream_lags(stream(spark, root)), root, "road_lags")
    feed(spark, root, rows[150:380])
    run(state.stream_lags(stream(spark, root)), root, "road_lags")
    early, late = (state.buffer_snapshot(spark, f"{root}/state_road_lags", b).groupBy("location_name").count().collect() for b in (0, None))
    assert {r["count"] for r in early} == {75} and {r["count"] for r in late} == {fv.BUFFER_ROWS}
    state.buffer_snapshot(spark, f"{root}/state_road_lags").write.parquet(f"{root}/buffers")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    feed(spark, f"{root}/more", rows[380:])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 3)
        run(state.stream_lags(stream(spark, f"{root}/more"), spark.read.parquet(f"{root}/buffers")), f"{root}/more", "road_lags")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    for r in rows_of(spark, f"{root}/more", "road_lags").collect():
        own = [x for x in rows if x[2] == r["location_name"] and x[0] <= r["reading_id"]]
        assert r["buffered"] == fv.BUFFER_ROWS
        assert [r[f"speed_lag_{label}"] for label in fv.LAG_ROWS] == [own[-1 - back][3] for back in fv.LAG_ROWS.values()]


def test_cooldown_state_across_batches(spark, root):
    for part in ([alert(1, 0), alert(2, 5)], [alert(3, 9.99), alert(4, 10, "critical")], [alert(5, 19)], [alert(6, 60), alert(7, 61)]):
        feed(spark, root, part, ALERT)
        run(state.stream_cooldown(stream(spark, root, ALERT)), root, "alerts")
    assert sorted(r["alert_id"] for r in rows_of(spark, root, "alerts").collect()) == [1, 4, 6]


def test_alert_jobs_equal_the_batch_when_rounds_are_split(spark, root, small):
    scored = t.scored(spark, small).cache()
    rounds = alerts.with_round(scored, 3600).filter((F.minute("request_time") >= 20) & (F.minute("request_time") < 40)).count()
    assert rounds > 100  # the files below cut rounds at half past
    cuts = ["2024-01-01 00:00:00", "2024-01-08 03:30:00", "2024-01-11 10:30:00", "2024-01-11 10:45:00", "2024-01-21 07:30:00", "2024-02-01 00:00:00"]
    for first, last in zip(cuts, cuts[1:]):
        part = scored.filter((F.col("request_time") >= first) & (F.col("request_time") < last))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        jobs.raise_alerts(source, root, f"{root}/raise", 3600, once=True).awaitTermination()
    jobs.close_rounds(spark, root, scored.schema, 3600)
    raised = rows_of(spark, root, "raised_alerts")
    expected = alerts.raised_alerts(scored, 3600)
    assert raised.count() == expected.count()
    assert raised.select("alert_id", "message").exceptAll(expected.select("alert_id", "message")).count() == 0
    jobs.send_alerts(spark, root, f"{root}/send", lateness="60 days", once=True).awaitTermination()
    sent = {r["alert_id"] for r in rows_of(spark, root, "alerts").collect()}
    assert sent == {r["alert_id"] for r in alerts.sent_alerts(scored, 3600).collect()}


def test_late_readings_are_kept_apart(spark, root, small):
    scored = t.scored(spark, small).orderBy("request_time")
    rows = scored.limit(40).collect()
    for part in (rows[:5] + rows[6:30], rows[30:], rows[5:6]):
        spark.createDataFrame(part, scored.schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        jobs.raise_alerts(source, root, f"{root}/raise", 3600, once=True).awaitTermination()
    assert [r["reading_id"] for r in rows_of(spark, root, "late_readings").collect()] == [rows[5]["reading_id"]]
    held = tables.read_version(spark, root, "open_readings")
    newest = max(r["request_time"] for r in rows)
    assert {r["request_time"].hour for r in held.collect()} == {newest.hour}


SNAPSHOT = "snapshot_key string, generated_at timestamp, snapshot_id long"


def test_snapshots_are_repeated_after_their_time(spark, root):
    at = lambda s: START + timedelta(seconds=s)
    parts = ([("x", at(0), 1), ("y", at(1), 2)], [("x", at(100), 3), ("x", at(239), 4)], [("z", at(900), 5), ("x", at(1000), 6), ("x", at(5000), 7)])
    for part in parts:
        feed(spark, root, part, SNAPSHOT)
        run(windows.distinct_snapshots(stream(spark, root, SNAPSHOT)), root, "ai_summaries")
    assert sorted(r["snapshot_id"] for r in rows_of(spark, root, "ai_summaries").collect()) == [1, 2, 5, 6, 7]
    table = spark.createDataFrame([r for part in parts for r in part], SNAPSHOT)
    assert sorted(r["snapshot_id"] for r in windows.distinct_snapshots(table).collect()) == [1, 2, 5, 6, 7]


def test_cooldown_is_forgotten_after_twice_its_time(spark, root):
    parts = ([alert(1, 0)], [alert(2, 5)], [(3, START + timedelta(minutes=40), "B", "K", "info", "info:K", "m")], [alert(4, 41)], [alert(5, 45)])
    for part in parts:
        feed(spark, root, part, ALERT)
        run(state.stream_cooldown(stream(spark, root, ALERT)), root, "alerts")
    assert sorted(r["alert_id"] for r in rows_of(spark, root, "alerts").collect()) == [1, 3, 4]


def test_latest_records_are_updated(spark, root):
    columns = ["current_speed", "event_time"]
    for part in ([reading(1, 0, speed=1.0), reading(2, 5, speed=2.0)], [reading(3, 3, speed=3.0), reading(4, 1, "B", 4.0)]):
        feed(spark, root, part)
        found = windows.latest_records(stream(spark, root), ["event_time", "reading_id"], columns).withColumnRenamed("event_time", "request_time")
        jobs.keep_latest(found, root, "latest_records", f"{root}/latest", once=True).awaitTermination()
    newest = tables.read_version(spark, root, "latest_records").collect()
    assert {r["location_name"]: (r["current_speed"], r["first_seen"].minute) for r in newest} == {"A": (2.0, 0), "B": (4.0, 1)}


def test_buffer_size_is_the_longest_lag_plus_one():
    assert fv.BUFFER_ROWS == max(fv.LAG_ROWS.values()) + 1
