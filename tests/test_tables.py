"""Sources, sinks, dimension seeds and the statistics document."""

import pathlib
import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from checks import tables as t
from roadweave import fixed_values as fv
from roadweave.plans import alerts, mart_refresh, marts, stats, warehouse
from roadweave.sources import dimensions, messages, stats_document, tables


def test_seeds(spark):
    roads = dimensions.seed_locations(spark)
    assert roads.count() == 25 and roads.filter("location_name = 'Al Manial St'").first()["district"] == "Manial"
    assert [f.dataType.typeName() for f in roads.schema] == ["integer", "string", "double", "double", "string", "string"]
    assert dimensions.seed_weather(spark).count() == 12
    times = dimensions.seed_times(spark)
    assert times.count() == 168 and times.select("hour", "day_of_week").distinct().count() == 168
    assert times.filter("is_weekend").select("day_name").distinct().count() == 2
    assert times.filter("day_of_week = 5 and hour = 7").first()["day_name"] == "Friday"
    assert times.filter("time_period is null").count() == 0


def test_star_lookup_moves_no_readings(spark, small):
    """Fixed dimensions are broadcast at once: the only shuffle is the one of the aggregate."""
    facts = warehouse.enriched_facts(t.fact(spark, small), t.dimensions(spark))
    plan = marts.rush_hour_analysis(facts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 6 and plan.count("Exchange hashpartitioning") == 1


def test_insert_if_absent_keeps_what_is_there(spark):
    old = spark.createDataFrame([("A", 1)], "name string, v int")
    new = spark.createDataFrame([("A", 2), ("B", 3), ("B", 3)], "name string, v int")
    assert sorted(map(tuple, dimensions.insert_if_absent(old, new, ["name"]).collect())) == [("A", 1), ("B", 3)]


def test_append_prunes_by_date(spark, small, tmp_path):
    readings = t.readings(spark, small)
    tables.append_table(readings, str(tmp_path), "raw_events")
    later = tables.read_table(spark, str(tmp_path), "raw_events", date(2024, 1, 20))
    assert later.count() == readings.filter("request_time >= '2024-01-20'").count()
    assert "PartitionFilters: [isnotnull(event_date" in later._jdf.queryExecution().executedPlan().toString()


def test_a_repeated_batch_replaces_itself(spark, small, tmp_path):
    facts = t.fact(spark, small)
    for batch_id in (0, 1, 1):
        tables.replace_batch(facts, str(tmp_path), "fact_traffic", batch_id)
    assert spark.read.parquet(f"{tmp_path}/fact_traffic").count() == 2 * facts.count()


def test_messages_survive_files(spark, small, tmp_path):
    body = t.messages(spark, small).drop("reading_id", "arrived_at")
    messages.write_message_files(messages.as_messages(body), str(tmp_path / "in"))
    back = messages.read_message_files(spark, str(tmp_path / "in"))
    assert back.count() == body.count()
    assert back.exceptAll(body.select(*back.columns)).count() == 0


def test_csv_round_trip(spark, small, tmp_path):
    df = t.readings(spark, small).select("reading_id", "location_name", "current_speed")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), "reading_id long, location_name string, current_speed double")
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()


def test_export_and_expiry(spark, small, tmp_path):
    """Also in a session with a temporary view, beside a stored view and a table without ds."""
    t.dim_location(spark).createOrReplaceTempView("some_staging_view")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS exports LOCATION '{tmp_path}'")
    spark.sql("CREATE VIEW IF NOT EXISTS exports.some_view AS SELECT 1 AS one")
    spark.range(3).write.mode("overwrite").saveAsTable("exports.some_table")
    tabs = {"dim_time": dimensions.seed_times(spark), "fact_traffic": t.fact(spark, small)}
    for day in (date(2024, 1, 1), date(2024, 1, 25), date(2024, 2, 4), date(2024, 2, 4)):
        counts = tables.export_warehouse(tabs, "exports", day, str(tmp_path))
    assert counts["dim_time"] == (168, 168)
    dropped = tables.expire_exports(spark, "exports", date(2024, 2, 4))
    assert sorted(dropped) == ["dim_time/ds=2024-01-01", "fact_traffic/ds=2024-01-01"]
    assert spark.table("exports.dim_time").count() == 2 * 168


def test_marts_are_rebuilt(spark, small, tmp_path):
    facts = warehouse.enriched_facts(t.fact(spark, small), t.dimensions(spark))
    for _ in range(2):
        built = marts.build_marts(facts, str(tmp_path))
    assert built["district_overview"].count() == 5
    assert spark.table("stg_traffic_enriched").count() == facts.count()


def test_a_refresh_reads_changed_days_only(spark, small, tmp_path):
    """The marts equal a full rebuild after a day came and another lost all its facts, while files of other days can't be read."""
    dims, root = t.dimensions(spark), str(tmp_path)
    facts = t.fact(spark, small).withColumn("event_date", F.to_date("event_time"))
    old, new, gone = (facts.filter(f"event_date {test}") for test in ("< '2024-01-28'", "between '2024-01-28' and '2024-01-29'", "= '2024-01-05'"))
    old.write.partitionBy("event_date").parquet(f"{root}/facts")

    def facts_of(days):
        rows = spark.read.schema(facts.schema).parquet(f"{root}/facts").filter(F.col("event_date").isin(days))
        return warehouse.enriched_facts(rows.drop("event_date"), dims)

    days = [r[0] for r in old.select("event_date").distinct().collect()]
    mart_refresh.refresh_marts(spark, facts_of, root, days)
    assert gone.count() > 0
    shutil.rmtree(f"{root}/facts/event_date=2024-01-05")
    new.write.mode("append").partitionBy("event_date").parquet(f"{root}/facts")
    for file in pathlib.Path(root, "facts", "event_date=2024-01-10").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    changed = [date(2024, 1, 5), date(2024, 1, 28), date(2024, 1, 29)]
    for _ in range(2):
        made = mart_refresh.refresh_marts(spark, facts_of, root, changed)
    everything = warehouse.enriched_facts(facts.filter("event_date < '2024-01-30' AND event_date <> '2024-01-05'").drop("event_date"), dims)
    for name, (build, _) in marts.MARTS.items():
        expected = build(everything).select(*made[name].columns)
        assert made[name].exceptAll(expected).count() == 0 and expected.count() == made[name].count(), name


def test_mode_ignores_missing_and_takes_the_smallest(spark):
    rows = [("d", "r", "Heavy"), ("d", "r", "Severe"), ("d", "q", "Severe"), ("d", "q", "Heavy"), ("d", "q", None)]
    facts = spark.createDataFrame(rows, "district string, location_name string, congestion_level string").withColumns(
        {c: F.lit(1.0) for c in ("current_speed", "congestion_ratio", "temperature")})
    row = marts.district_overview(facts.filter("congestion_level is not null")).first()
    assert row["dominant_congestion"] == "Heavy" and row["road_count"] == 2


def test_weather_baseline_is_missing_without_clear_sky(spark, small):
    facts = warehouse.enriched_facts(t.fact(spark, small), t.dimensions(spark)).filter("weather_condition <> 'Clear'")
    assert marts.weather_impact_analysis(facts).filter("speed_diff_from_clear is not null").count() == 0


HISTORY = "location_name string, requested_lat double, requested_lon double, frc string, current_speed double, free_flow_speed double, congestion_ratio double, delay_seconds int, id int"


def document(spark):
    rows = [("Known", 30.0444, 31.2357, "FRC1", 20.0, 40.0, 0.5, 10, 2), ("Known", 30.0444, 31.2357, "FRC2", 40.0, 40.0, 1.0, 0, 1),
            (None, 29.97, 31.26, "FRC3", 90.0, 90.0, 1.0, 5, 3)]
    return stats.location_statistics(spark.createDataFrame(rows, HISTORY), ["id"])


def test_statistics_fall_back_by_tier(spark, tmp_path):
    stats_document.write_stats(document(spark), str(tmp_path / "stats"))
    stored = stats_document.read_stats(spark, str(tmp_path / "stats"))
    levels = {(r["level"], r["key"]): r for r in stored.collect()}
    assert set(levels) == {("city", ""), ("district", "Downtown Cairo"), ("district", "Maadi"), ("location", "Known")}
    assert levels[("city", "")]["avg_speed"] == 50.0 and levels[("location", "Known")]["frc"] == "FRC2"
    asked = spark.createDataFrame(
        [("Known", None, None), ("Road A", 29.97, 31.26), ("Mystery", 0.0, 0.0), ("Nowhere", None, None)],
        "location_name string, requested_lat double, requested_lon double")
    got = {r["location_name"]: r["stats"] for r in stats.with_location_stats(asked, stored).collect()}
    assert (got["Known"]["source"], got["Known"]["avg_speed"], got["Known"]["district"]) == ("location", 30.0, "Downtown Cairo")
    assert (got["Road A"]["source"], got["Road A"]["district"], got["Road A"]["avg_speed"]) == ("district", "Maadi", 90.0)
    # nearest district is Giza, which the document lacks
    assert (got["Mystery"]["source"], got["Mystery"]["district"], got["Mystery"]["avg_speed"]) == ("city_wide", "Giza", 50.0)
    assert (got["Nowhere"]["source"], got["Nowhere"]["district"]) == ("city_wide", "Unknown")


def test_constants_without_a_document(spark, tmp_path):
    stored = stats_document.read_stats(spark, str(tmp_path / "missing"))
    asked = spark.createDataFrame([("A", 30.05, 31.24)], "location_name string, requested_lat double, requested_lon double")
    got = stats.with_location_stats(asked, stored).first()["stats"]
    assert (got["avg_speed"], got["avg_congestion_ratio"], got["source"]) == (24.0, 0.71, "city_wide")


def test_nested_document(spark, tmp_path):
    numbers = '"avg_speed": 1.0, "avg_free_flow_speed": 2.0, "avg_congestion_ratio": 0.5, "avg_delay_seconds": 3.0, "sample_count": 4'
    (tmp_path / "doc.json").write_text('{"city_wide": {%s}, "districts": {"Maadi": {%s}}, "locations": {"A": {%s, "district": "Maadi", "lat": 1.0, "lon": 2.0, "frc": "FRC1"}}}'
                                       % (numbers, numbers, numbers))
    rows = stats_document.read_nested_stats(spark, str(tmp_path / "doc.json")).collect()
    assert sorted((r["level"], r["key"], r["district"]) for r in rows) == [("city", "", None), ("district", "Maadi", None), ("location", "A", "Maadi")]


def test_new_closures_across_rounds_and_batches(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [(1, at(1), "A", True), (2, at(2), "A", True), (3, at(3), "A", False), (4, at(4), "A", True), (5, at(6), "A", True), (6, at(6, 5), "A", True)]
    rounds = alerts.with_round(spark.createDataFrame(rows, "reading_id long, request_time timestamp, location_name string, road_closure boolean"), 3600)
    assert sorted(r["reading_id"] for r in alerts.new_closures(rounds, 3600).collect()) == [1, 4, 5, 6]
    earlier = spark.createDataFrame([("A", at(0))], "location_name string, round_start timestamp")
    assert sorted(r["reading_id"] for r in alerts.new_closures(rounds, 3600, earlier).collect()) == [4, 5, 6]


def test_scheduled_rounds(spark):
    df = spark.createDataFrame([("2024-01-01 05:17:00",), ("2024-01-01 09:45:00",), ("2024-01-01 22:50:00",)], "t string")
    start = alerts.round_start(F.col("t").cast("timestamp"))
    got = df.select(start.cast("string"), alerts.previous_round(start).cast("string")).collect()
    # local time is two hours ahead: ten minutes, twenty minutes and half an hour
    assert [tuple(r) for r in got] == [("2024-01-01 05:10:00", "2024-01-01 05:00:00"), ("2024-01-01 09:40:00", "2024-01-01 09:20:00"),
                                       ("2024-01-01 22:30:00", "2024-01-01 22:00:00")]


@pytest.mark.parametrize("pct, severity", [(40.0, None), (40.1, "warning"), (60.0, "warning"), (60.1, "critical")])
def test_city_alert_limits(spark, pct, severity):
    from roadweave.functions.alerts import city_alert

    row = spark.createDataFrame([(pct, 1, 2, 3, 4)], "pct double, Moderate int, Heavy int, Severe int, Closed int").select(city_alert().alias("a")).first()["a"]
    assert (row and row["severity"]) == severity
    if severity == "critical":
        assert row["message"] == "60% of roads showing congestion or closure. Moderate:1 Heavy:2 Severe:3 Closed:4"


def test_empty_city_snapshot(spark, small):
    from checks.series import latest_state
    from roadweave.plans.snapshot import city_snapshot

    row = city_snapshot(latest_state(spark, small).filter("false")).first()
    assert (row["timestamp"], row["city_avg_speed"], row["n_locations"], row["city_heavy_pct"]) == (None, None, 0, 0.0)
    assert row["top_hotspots"] == [] and row["free_flowing"] == []


def test_fixed_lists_are_complete():
    assert len(fv.SEED_ROADS) == len(fv.KNOWN_POINTS) == 25 and len(fv.DISTRICT_BOXES) == 8
    assert (len(fv.CONGESTION_FEATURES), len(fv.ANOMALY_FEATURES), len(fv.FORECAST_FEATURES)) == (23, 12, 32)
