"""Lookups in tables of places against brute force; the streaming as-of join on late, missing and repeated rows."""

import math
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadweave.functions.geo import district_by_box
from roadweave import fixed_values as fv
from roadweave.operators import places as operator
from roadweave.operators.places import first_rectangle, nearest_place
from roadweave.session import checkpoint_dir
from roadweave.streaming import jobs, state
from roadweave.streaming.asof import stream_asof_join

POINT, PLACE, BOX = "id int, lat double, lon double", "n int, lat double, lon double", "n int, south double, north double, west double, east double"


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_nearest_place_equals_all_pairs(spark):
    rng = random.Random(2)
    somewhere = lambda: rng.choice([
        (30 + rng.random() / 9, 31 + rng.random() / 9), (rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.choice([89.9, -89.99]), rng.uniform(-180, 180)),
        (rng.uniform(-1, 1), rng.choice([179.95, -179.95]))])
    places = [(i, *somewhere()) for i in range(80)] + [(80, 30.0, 31.0), (81, 30.0, 31.0)]
    points = [(i, *somewhere()) for i in range(150)] + [(150, 30.0, 31.0), (151, None, 1.0), (152, 1.0, None), (153, 90.0, 0.0), (154, 0.0, 180.0), (155, 0.0, -180.0)]
    points += [(200 + i, 30.01, 31.01) for i in range(50)]
    made = {r["id"]: r["nearest"] for r in nearest_place(spark.createDataFrame(points, POINT), spark.createDataFrame([*places, (99, None, 3.0)], PLACE),
                                                         "lat", "lon", "n").collect()}
    assert len(made) == len(points)
    for i, lat, lon in points:
        if lat is None or lon is None:
            assert made[i] is None
            continue
        best = min((km(lat, lon, a, b), n) for n, a, b in places)
        assert math.isclose(made[i]["km"], best[0], abs_tol=1e-6) and (made[i]["n"] == best[1] or abs(km(lat, lon, made[i]["lat"], made[i]["lon"]) - best[0]) < 1e-6)
    assert made[150]["n"] == 80


def test_nearest_of_no_place(spark):
    rows = nearest_place(spark.createDataFrame([(1, 1.0, 2.0)], POINT), spark.createDataFrame([], PLACE), "lat", "lon", "n").collect()
    assert len(rows) == 1 and rows[0]["nearest"] is None


def test_far_points_are_compared_with_few_places(spark):
    rng = random.Random(5)
    places = [(i, 29 + rng.random(), 30 + rng.random()) for i in range(1500)]
    points = [(i, rng.uniform(28, 31), rng.uniform(30, 33)) for i in range(4000)] + [(4000 + i, rng.uniform(28, 31), -179.99) for i in range(1000)]
    points_df, places_df = spark.createDataFrame(points, POINT), spark.createDataFrame(places, PLACE)
    runs, height = operator._in_runs(operator._coordinates(points_df, "lat", "lon"), "_lat", "_lon", 2)
    assert runs.groupBy("_run").count().agg(F.max("count")).first()[0] <= 4
    known, q_height = operator._in_runs(places_df.selectExpr("cast(n as bigint) _n", "lat qlat", "lon qlon"), "qlat", "qlon", operator.PLACE_BITS)
    pairs = runs.join(operator._near(runs, height, known, q_height), F.col("_run") == F.col("prun")).count()
    assert pairs < len(points) * len(places) / 8, pairs
    made = {r["id"]: r["nearest"]["n"] for r in nearest_place(points_df, places_df, "lat", "lon", "n").collect()}
    for i, lat, lon in points[::31]:
        best = min(km(lat, lon, a, b) for _, a, b in places)
        assert math.isclose(km(lat, lon, *places[made[i]][1:]), best, abs_tol=1e-6)


def test_places_and_points_that_are_no_numbers(spark):
    nan, inf = math.nan, math.inf
    points = spark.createDataFrame([(1, nan, 1.0), (2, 1.0, inf), (3, 0.0, -0.0)], POINT)
    made = {r["id"]: r["nearest"] for r in nearest_place(points, spark.createDataFrame([(0, nan, 0.0), (7, 1.0, 1.0)], PLACE), "lat", "lon", "n").collect()}
    assert made[1] is None and made[2] is None and made[3]["n"] == 7


def test_first_rectangle_equals_all_pairs(spark):
    rng = random.Random(3)
    boxes = []
    for i in range(300):
        south, west, size = rng.uniform(-60, 60), rng.uniform(-170, 170), rng.choice([0, 0.001, 0.02, 1, 30, 200])
        boxes.append((i, south, south + size * rng.random(), west, west + size * rng.random()))
    boxes += [(300, 1.0, 0.0, 1.0, 2.0), (301, None, 1.0, 1.0, 2.0), (302, -90.0, 90.0, -180.0, 180.0)]
    points = [(i, rng.uniform(-70, 70), rng.uniform(-180, 180)) for i in range(400)] + [(400 + b[0], b[1], b[3]) for b in boxes[:200]] + [(900, None, 1.0)]
    made = {r["id"]: r["rectangle"] for r in first_rectangle(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX), "lat", "lon", "n").collect()}
    for i, lat, lon in points:
        held = [] if lat is None else [n for n, s, e, w, o in boxes if s is not None and s <= lat <= e and w <= lon <= o]
        assert (made[i] and made[i]["n"]) == (min(held) if held else None)
    assert len(made) == len(points)


def test_later_rectangles_of_a_covered_run_are_not_looked_at(spark):
    rng = random.Random(6)
    boxes = [(i, 0.0 - rng.random(), 5.0 + rng.random(), 0.0 - rng.random(), 5.0 + rng.random()) for i in range(1000)]
    boxes[0] = (0, 1.0, 2.0, 1.0, 2.0)
    points = [(i, rng.uniform(-1, 6), rng.uniform(-1, 6)) for i in range(1200)]
    points_df, boxes_df = spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX)
    runs, height = operator._in_runs(operator._coordinates(points_df, "lat", "lon"), "_lat", "_lon", operator.RUN_BITS)
    looks = operator._looks(runs, height, boxes_df.withColumn("_n", F.col("n").cast("long")))
    assert runs.join(looks, "_run").count() < len(points) * len(boxes) / 4
    made = {r["id"]: r["rectangle"] for r in first_rectangle(points_df, boxes_df, "lat", "lon", "n").collect()}
    for i, lat, lon in points:
        first = next((n for n, s, e, w, o in boxes if s <= lat <= e and w <= lon <= o), None)
        assert (made[i] and made[i]["n"]) == first


def test_rectangles_without_end(spark):
    inf = math.inf
    boxes = spark.createDataFrame([(2, -inf, inf, -inf, inf), (1, 0.0, inf, 0.0, 2000.0)], BOX)
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, -1.0, 1.0), (3, None, 1.0), (4, math.nan, 1.0)], POINT)
    assert {r["id"]: r["rectangle"] and r["rectangle"]["n"] for r in first_rectangle(points, boxes, "lat", "lon", "n").collect()} == {1: 1, 2: 2, 3: None, 4: None}


def test_given_rectangles_as_a_table_equal_the_case_form(spark):
    rng = random.Random(4)
    points = spark.createDataFrame([(i, rng.uniform(29.9, 30.2), rng.uniform(31.0, 31.5)) for i in range(500)] + [(501, 30.03, 31.255)], POINT)
    boxes = spark.createDataFrame([(i, s, n, w, e, name) for i, (name, s, n, w, e) in enumerate(fv.DISTRICT_BOXES)], BOX + ", name string")
    found = first_rectangle(points, boxes, "lat", "lon", "n").withColumn("case", district_by_box("lat", "lon"))
    assert found.filter(~F.col("case").eqNullSafe(F.col("rectangle.name"))).count() == 0 and found.filter("case IS NOT NULL").count() > 50


START = datetime(2024, 1, 1)


@pytest.mark.parametrize("by", [[], ["city"]])
def test_stream_asof_with_late_weather_and_missing_rounds(spark, by):
    state.use_rocksdb(spark)
    root = f"{checkpoint_dir(spark)}/tests/{uuid.uuid4().hex}"
    at = lambda m: START + timedelta(minutes=m)
    left, right = "city string, id long, at timestamp, speed double", "city string, wid long, seen timestamp, rain double"
    cities = ["a", "b"] if by else ["a"]
    batches = [
        ([(1, 0), (2, 9)], [(1, 5, 1.0)]),
        ([(3, 14), (4, 36), (10, 15)], [(2, 12, 2.0), (3, 12, 2.5)]),
        ([(5, 47)], [(4, 33, None), (5, 35, 4.0)]),  # 33 and 35 come after the reading of 36
        ([(6, 500), (7, 520)], [(6, 490, 5.0), (7, 530, 6.0)]),
    ]
    for readings, weather in batches:
        spark.createDataFrame([(c, i, at(m), None if i == 3 else 1.5) for c in cities for i, m in readings], left).coalesce(1).write.mode("append").parquet(f"{root}/l")
        spark.createDataFrame([(c, i, at(m), x if c == "a" or x is None else -x) for c in cities for i, m, x in weather], right).coalesce(1).write.mode("append").parquet(f"{root}/r")
        source = lambda side, schema: spark.readStream.schema(schema).parquet(f"{root}/{side}")
        found = stream_asof_join(source("l", left), source("r", right), "at", "id", "seen", "wid", ["rain"], 1800, "20 minutes", by, salts=2)
        jobs.start(found.withColumn("request_time", F.col("at")), root, "raw_events", f"{root}/state", once=True).awaitTermination()
    rows = spark.read.parquet(f"{root}/raw_events").collect()
    made = {(r["city"], r["id"]): r["rain"] for r in rows}
    assert len(made) == len(rows)
    # 4: the newest at its time, though it came later; 6 is not passed by 20 minutes when the streams end at 520 and 530
    plain = {1: None, 2: 1.0, 3: 2.5, 10: 2.5, 4: 4.0, 5: 4.0}
    assert made == {("a", i): x for i, x in plain.items()} | ({("b", i): x and -x for i, x in plain.items()} if by else {})
    assert next(r for r in rows if r["id"] == 3)["speed"] is None
