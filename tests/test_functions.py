"""Boundary values of the column functions."""

import pytest
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions import features, geo, lookups, quality, texts
from roadweave.functions.numeric import rounded
from roadweave.sources import payloads


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + schema)
    return [r[0] for r in df.select("n", column.alias("v")).orderBy("n").select("v").collect()]


def test_rounding_is_half_up_on_decimals(spark):
    got = values(spark, [(0.145,), (2.5,), (-0.145,), (1.005,), (None,)], "x double", rounded(F.col("x"), 2))
    assert got == [0.15, 2.5, -0.15, 1.01, None]


def test_congestion_levels(spark):
    rows = [(0.75, False), (0.7499, False), (0.5, False), (0.25, False), (0.2499, None), (None, False), (0.9, True), (None, True)]
    got = values(spark, rows, "r double, c boolean", lookups.congestion_level(F.col("r"), F.col("c")))
    assert got == ["Free Flow", "Moderate", "Moderate", "Heavy", "Severe", "Severe", "Closed", "Closed"]


def test_exploration_levels(spark):
    got = values(spark, [(0.8,), (0.6,), (0.4,), (0.2,), (0.19,), (None,)], "r double", lookups.eda_level(F.col("r")))
    assert got == ["Free Flow", "Light", "Moderate", "Heavy", "Severe", "Unknown"]


def test_zero_and_missing_take_the_default_but_negative_does_not(spark):
    got = values(spark, [(0.0,), (None,), (-4.0,), (12.0,)], "t double", features.or_default(F.col("t"), 25.0))
    assert got == [25.0, 25.0, -4.0, 12.0]


def test_periods_and_rush(spark):
    hours = [(h,) for h in (0, 5, 6, 7, 9, 10, 15, 16, 19, 20, 23)]
    assert values(spark, hours, "h int", lookups.time_period_name(F.col("h"))) == [
        "Late Night", "Late Night", "Early Morning", "Morning Rush", "Morning Rush", "Midday", "Midday",
        "Evening Rush", "Evening Rush", "Night", "Night"]
    assert values(spark, hours, "h int", lookups.time_period_code(F.col("h"))) == [0, 0, 1, 1, 1, 2, 3, 3, 3, 4, 4]
    assert values(spark, hours, "h int", lookups.is_rush_hour(F.col("h"))) == [False] * 3 + [True, True, False, False, True, True, False, False]


def test_every_known_road_lies_in_its_district(spark):
    df = spark.createDataFrame([(n, a, o, d) for n, a, o, d in fv.KNOWN_POINTS], "name string, lat double, lon double, expected string")
    found = geo.with_district(df, "lat", "lon")
    assert found.filter("district <> expected or district is null").count() == 0


@pytest.mark.parametrize("lat, lon, expected", [
    (30.0500, 31.2400, "Downtown Cairo"), (29.9700, 31.2600, "Maadi"), (30.0200, 31.1800, "Giza"),
    (30.1100, 31.3200, "Heliopolis"), (30.0800, 31.2300, "Shobra"), (30.0500, 31.3000, "Nasr City"),
    (30.0150, 31.2240, "Manial"), (30.0180, 31.2350, "Old Cairo"),
    (30.0300, 31.4500, "Nasr City"), (29.9500, 31.0000, "Giza"), (0.0, 0.0, "Giza"), (None, 31.0, None)])
def test_new_points(spark, lat, lon, expected):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert geo.with_district(df, "lat", "lon").first()["district"] == expected


def test_nearest_point_agrees_with_haversine(spark):
    import math

    def km(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    grid = [(29.0 + 0.037 * i, 30.0 + 0.053 * j) for i in range(40) for j in range(40)]
    df = geo.with_nearest_point(spark.createDataFrame(grid, "lat double, lon double"), "lat", "lon")
    for row in df.collect():
        distances = [km(row["lat"], row["lon"], p[1], p[2]) for p in fv.KNOWN_POINTS]
        assert distances.index(min(distances)) == row["nearest"]


def test_message_district_order(spark):
    rows = [("Here", 30.05, 31.24), ("", 30.05, 31.24), (None, 0.0, 31.24), (None, None, 31.24)]
    df = spark.createDataFrame(rows, "district string, requested_lat double, requested_lon double")
    assert [r["district"] for r in geo.with_message_district(df).collect()] == ["Here", "Downtown Cairo", "Unknown", "Unknown"]


MESSAGE = ("location_name string, requested_lat double, requested_lon double, current_speed double, free_flow_speed double, "
           "road_closure boolean, request_time string, weather_temp double, weather_humid int, weather_rain double")
GOOD = ("A", 30.0, 31.2, 40.0, 50.0, False, "2024-01-01T10:00:00", 20.0, 40, 0.0)


def checked(spark, as_of="2024-01-01 10:05:00", **changes):
    names = [part.split()[0] for part in MESSAGE.split(", ")]
    row = {**dict(zip(names, GOOD)), **changes}
    df = spark.createDataFrame([tuple(row[n] for n in names)], MESSAGE)
    got = quality.with_quality(df, F.lit(as_of).cast("timestamp")).first()
    return got["quality_score"], got["passed"], [(i["check"], i["severity"]) for i in got["issues"]], got


def test_good_message(spark):
    assert checked(spark)[:3] == (100, True, [])


def test_unusable_message_skips_the_other_checks(spark):
    score, passed, issues, _ = checked(spark, location_name="", requested_lat=None, current_speed=-5.0)
    assert (score, passed) == (0, False)
    assert issues == [("required_fields", "fatal"), ("required_fields", "fatal")]


def test_missing_speed_is_fatal_but_checks_go_on(spark):
    score, passed, issues, _ = checked(spark, current_speed=None, weather_temp=61.0)
    assert (score, passed) == (35, False)
    assert issues == [("speed_sanity", "fatal"), ("weather_sanity", "warning")]


def test_score_of_exactly_fifty_passes(spark):
    score, passed, _, _ = checked(spark, current_speed=201.0, weather_temp=-11.0, weather_humid=101)
    assert (score, passed) == (50, True)
    score, passed, _, _ = checked(spark, current_speed=201.0, free_flow_speed=0.0)
    assert (score, passed) == (40, False)


def test_age_of_exactly_ten_minutes_is_fresh(spark):
    assert checked(spark, as_of="2024-01-01 10:10:00")[2] == []
    assert checked(spark, as_of="2024-01-01 10:10:01")[2] == [("freshness", "warning")]


def test_times(spark):
    assert checked(spark, request_time="soon")[2] == [("freshness", "info")]
    assert checked(spark, request_time="")[2] == []
    assert checked(spark, request_time=None)[2] == []
    assert checked(spark, request_time="2024-01-01T12:00:00+02:00")[2] == []


def test_open_flow_on_a_closed_road(spark):
    *_, issues, row = checked(spark, road_closure=True, current_speed=40.0)
    assert issues == [("closure_consistency", "warning")]
    assert row["issues"][0]["message"] == "closure flag set but traffic flowing (speed=40.0 = 80% of free-flow 50.0)"
    assert checked(spark, road_closure=True, current_speed=0.0)[2] == []


def test_missing_free_flow_text(spark):
    assert checked(spark, free_flow_speed=None)[3]["issues"][0]["message"] == "invalid free_flow_speed: None"


def test_anomaly_reason(spark):
    rows = [(True, 80.0, -20.0, 6.5, -0.1), (False, 30.0, -10.0, 5.0, -0.12345)]
    got = values(spark, rows, "c boolean, d double, v double, r double, s double", texts.anomaly_reason(*map(F.col, "cdvrs")))
    assert got == ["road closure detected; speed 80% below free-flow; speed 20.0km/h below road average; heavy rain (6.5mm)",
                   "strong anomaly signal (score=-0.1235)"]


def test_texts(spark):
    assert values(spark, [("critical:X",), (":X",), (None,)], "a string", texts.alert_severity(F.col("a"))) == ["critical", "info", "info"]
    assert values(spark, [("x" * 80,), ("x" * 81,)], "a string", texts.shortened(F.col("a"))) == ["x" * 80, "x" * 80 + "…"]
    assert values(spark, [(90.0,), (0.0,), (-5.0,), (149.0,)], "s double", texts.delay_minutes(F.col("s"))) == [2, 0, 0, 2]


def test_poll_interval_follows_local_time(spark):
    at = F.col("t").cast("timestamp")
    rows = [("2024-01-01 05:30:00",), ("2024-07-01 05:30:00",), ("2024-01-01 21:30:00",)]
    assert values(spark, rows, "t string", lookups.poll_interval(at)["label"]) == ["morning rush", "morning rush", "night"]
    assert values(spark, rows, "t string", lookups.poll_interval(at, None)["seconds"]) == [1800, 1800, 1200]


def test_target_time_of_unknown_horizon(spark):
    at = F.lit("2024-01-01 10:00:00").cast("timestamp")
    got = values(spark, [("60min",), ("1d",), (None,)], "h string", lookups.target_time(at, F.col("h")).cast("string"))
    assert got == ["2024-01-01 11:00:00", "2024-01-01 10:00:00", "2024-01-01 10:00:00"]


def test_empty_payloads(spark):
    flow = payloads.parse_flow(spark.createDataFrame([(1, "{}")], "id int, payload string")).first()
    assert flow["frc"] is None and flow["road_closure"] is False
    weather = '{"main":{"temp":20,"feels_like":19,"humidity":40},"weather":[{"main":"Rain","description":"light"}],"wind":{"speed":2},"rain":{"1h":0.4}}'
    row = payloads.parse_weather(spark.createDataFrame([(1, weather)], "id int, payload string")).first()
    assert (row["temperature"], row["weather_main"], row["rain_mm"]) == (20.0, "Rain", 0.4)
