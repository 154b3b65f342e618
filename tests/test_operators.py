"""Table operators against brute force, with skewed and dense input."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators.asof import asof_join
from roadweave.operators.band import nearest_in_band
from roadweave.operators.cooldown import _with_pieces, suppress_repeats
from roadweave.operators.lags import with_lags, with_position
from roadweave.operators.latest import latest_per_key, previous_period, recent_per_key, since
from roadweave.operators.quantiles import quantiles
from roadweave.operators.sizing import broadcast_if_small, hot_keys, salt_of
from roadweave.plans.features import class_index

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def series(rows, keys=3, span=40_000, seed=1):
    """A third of all rows in one key, many equal times."""
    draw = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{draw.randrange(keys)}", at(draw.randrange(span) // 7 * 7), i, float(draw.randrange(500)))
            for i in range(rows)]


SERIES = "key string, ts timestamp, id long, v double"


@pytest.mark.parametrize("chunk_rows, slot", [(7, "hour"), (10, "day"), (1000, "minute")])
def test_lags_equal_the_uncut_series(spark, chunk_rows, slot):
    rows = series(400)
    got = with_lags(spark.createDataFrame(rows, SERIES), ["key"], "ts", "id",
                    {"back": ("v", 5), "one": ("v", 1), "ahead": ("v", -3)}, slot=slot, chunk_rows=chunk_rows)
    expected = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(own):
            value = lambda j: own[j][3] if 0 <= j < len(own) else None
            expected[r[2]] = (i + 1, value(i - 5), value(i - 1), value(i + 3))
    found = {r["id"]: (r["position"], r["back"], r["one"], r["ahead"]) for r in got.collect()}
    assert found == expected


@pytest.mark.parametrize("most", [1, 20, 1_000_000])
def test_positions_with_hot_slots_refined(spark, most):
    rows = series(500, span=300_000)
    got = with_position(spark.createDataFrame(rows, SERIES), ["key"], "ts", "id", most=most)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [r["id"] for r in got.filter(F.col("key") == key).orderBy("position").collect()] == [r[2] for r in own]
    assert got.agg(F.max("position")).first()[0] == max(sum(r[0] == k for r in rows) for k in {r[0] for r in rows})


def test_lag_deeper_than_a_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        with_lags(spark.createDataFrame(series(5), SERIES), ["key"], "ts", "id", {"x": ("v", 9)}, chunk_rows=9)


@pytest.mark.parametrize("tolerance, slot", [(600, 60), (1800, 300), (50, 300), (100_000, 5_000)])
def test_asof_equals_brute_force(spark, tolerance, slot):
    draw = random.Random(3)
    # two thirds of the left rows fall into one slot, so that it is salted
    left = [(i, at(draw.randrange(40) if i % 3 else draw.randrange(30_000))) for i in range(600)]
    right = [(i, at(draw.randrange(30_000)), f"w{i}") for i in range(60)] + [(100, at(20), "hot"), (101, at(20), "hot2")]
    got = asof_join(spark.createDataFrame(left, "id long, t timestamp"), spark.createDataFrame(right, "wid long, wt timestamp, w string"),
                    "t", "id", "wt", "wid", ["w"], tolerance, slot_seconds=slot)
    expected = {}
    for i, t in left:
        fits = [(wt, wid, w) for wid, wt, w in right if t - timedelta(seconds=tolerance) <= wt <= t]
        expected[i] = max(fits)[2] if fits else None
    assert {r["id"]: r["w"] for r in got.collect()} == expected


def test_asof_by_key(spark):
    left = spark.createDataFrame([(1, at(100), "a"), (2, at(100), "b")], "id long, t timestamp, city string")
    right = spark.createDataFrame([(1, at(90), "a", 5.0)], "wid long, wt timestamp, city string, temp double")
    got = asof_join(left, right, "t", "id", "wt", "wid", ["temp"], 600, by=["city"])
    assert sorted((r["id"], r["temp"]) for r in got.collect()) == [(1, 5.0), (2, None)]


def test_hot_keys_are_few_and_get_salts(spark):
    df = spark.createDataFrame(series(900), SERIES)
    hot = {r["key"]: r["salts"] for r in hot_keys(df, ["key"], parts=4).collect()}
    assert hot["hot"] == 2 and len(hot) < 4
    salts = df.select(salt_of(F.col("id"), F.lit(3)).alias("s")).distinct().collect()
    assert sorted(r["s"] for r in salts) == [0, 1, 2]


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(50)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(broadcast_if_small(df, 50)).lower()
    assert "broadcast" not in plan(broadcast_if_small(df, 49)).lower()


@pytest.mark.parametrize("cooldown, block, step", [(600, 86_400, 7), (600, 900, 1), (5_000, 3_600, 60), (40_000, 3_600, 13), (600, 600, 300)])
def test_cooldown_equals_the_sequential_rule(spark, cooldown, block, step):
    draw = random.Random(cooldown + block)
    rows = [("hot" if i % 3 == 0 else f"k{draw.randrange(4)}", at(draw.randrange(90_000) // step * step), i) for i in range(1500)]
    got = suppress_repeats(spark.createDataFrame(rows, "key string, ts timestamp, id long"), ["key"], "ts", "id", cooldown, block)
    last, expected = {}, set()
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts - last[key] >= timedelta(seconds=cooldown):
            last[key] = ts
            expected.add(i)
    assert {r["id"] for r in got.collect()} == expected


@pytest.mark.parametrize("cooldown, most", [(600, 50), (30, 200), (90_000, 20)])
def test_cooldown_of_a_hot_key_and_day(spark, cooldown, most):
    """Nine tenths of the rows in one key and day, cut into pieces of at most ``most`` instants."""
    draw = random.Random(most)
    rows = [("hot", at(86_400 + draw.randrange(86_400) ** 2 / 86_400), i) for i in range(1800)]
    rows += [(f"k{draw.randrange(3)}" if i % 2 else "hot", at(draw.randrange(4 * 86_400)), i) for i in range(1800, 2000)]
    got = suppress_repeats(spark.createDataFrame(rows, "key string, ts timestamp, id long"), ["key"], "ts", "id", cooldown, most_instants=most)
    last, expected = {}, set()
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts - last[key] >= timedelta(seconds=cooldown):
            last[key] = ts
            expected.add(i)
    assert {r["id"] for r in got.collect()} == expected


def test_pieces_of_a_hot_day_are_of_like_size(spark):
    days = spark.range(90_000).selectExpr("'hot' AS key", "0L AS _block", "id * 900000 AS _t", "id AS _first").unionByName(
        spark.range(10_000).selectExpr("concat('k', id % 10)", "id % 3", "(id % 3) * 86400000000 + id * 8000000", "id").toDF("key", "_block", "_t", "_first"))
    pieces = _with_pieces(days, ["key", "_block"], 86_400_000_000, 2_000)
    sizes = sorted(r["count"] for r in pieces.groupBy("key", "_block", "_node").count().collect())
    assert sum(sizes) == 100_000 and sizes[-1] <= 2_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_cooldown_boundary(spark):
    rows = [("a", at(0), 1), ("a", at(599), 2), ("a", at(600), 3), ("a", at(1199), 4), ("b", at(1), 5)]
    got = suppress_repeats(spark.createDataFrame(rows, "key string, ts timestamp, id long"), ["key"], "ts", "id", 600)
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 5]


def test_band_join_equals_brute_force(spark):
    draw = random.Random(5)
    spot = lambda: (round(30 + draw.randrange(80) * 1e-4, 6), round(31 + draw.randrange(80) * 1e-4, 6))
    places = [(f"p{i}", *spot()) for i in range(60)] + [("nowhere", None, 31.0), ("far", 40.0, 40.0)]
    events = [(i, *(spot() if i % 3 else (30.004, 31.004))) for i in range(400)]
    got = nearest_in_band(spark.createDataFrame(places, "name string, lat double, lon double"),
                          spark.createDataFrame(events, "id long, lat double, lon double"), "name", ["id"])
    expected = {}
    for name, lat, lon in places:
        if lat is not None:
            near = [(abs(a - lat) + abs(b - lon), i) for i, a, b in events if abs(a - lat) < 0.002 and abs(b - lon) < 0.002]
            if near:
                expected[name] = min(near)[1]
    assert {r["near_road"]: r["id"] for r in got.collect()} == expected


@pytest.mark.parametrize("most", [5, 100])
def test_band_join_with_a_dense_cell(spark, most):
    """Nine tenths of the events at different coordinates of one cell."""
    draw = random.Random(most)
    radius = 0.5
    events = [(i, 10 + draw.random() ** 3 * 0.4, 20.3 + draw.random() * 0.05, i % 5) for i in range(900)]
    events += [(i, 8 + draw.randrange(40) / 10, 18 + draw.randrange(40) / 10, i % 5) for i in range(900, 1000)]
    places = [(f"p{i}", 9 + draw.randrange(200) / 100, 19 + draw.randrange(200) / 100) for i in range(150)] + [("far", 50.0, 50.0), ("none", None, 1.0)]
    got = nearest_in_band(spark.createDataFrame(places, "name string, lat double, lon double"),
                          spark.createDataFrame(events, "id long, lat double, lon double, kind int"), "name", ["kind", "id"], radius, most)
    expected = {}
    for name, lat, lon in places:
        near = [] if lat is None else [(abs(y - lat) + abs(x - lon), kind, i) for i, y, x, kind in events if abs(y - lat) < radius and abs(x - lon) < radius]
        if near:
            expected[name] = (min(near)[2], min(near)[0])
    assert {r["near_road"]: (r["id"], r["distance"]) for r in got.collect()} == expected


def test_labels_are_numbered_over_many_ranges(spark):
    rows = spark.range(5_000).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE concat('v', (id * 7919) % 1000) END AS v").repartition(13)
    index = class_index(rows, "v")
    values = sorted({r["v"] for r in rows.collect()} - {None})
    assert {r["v"]: r["index"] for r in index.collect()} == {v: i for i, v in enumerate(values)}
    assert class_index(rows.limit(0), "v").count() == 0


@pytest.mark.parametrize("bins", [3, 25, 1024])
def test_quantiles_equal_numpy(spark, bins):
    rows = series(500) + [("single", at(0), 900, 4.5), ("none", at(0), 901, None), ("neg", at(0), 902, -3.25), ("neg", at(0), 903, -1.0)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(spark.createDataFrame(rows, SERIES), ["key"], "v", probs, bins).collect()
    for row in got:
        own = [r[3] for r in rows if r[0] == row["key"] and r[3] is not None]
        assert row["n"] == len(own)
        assert np.allclose(row["quantiles"], np.quantile(own, probs))
    assert {r["key"] for r in got} == {r[0] for r in rows} - {"none"}
    whole = quantiles(spark.createDataFrame(rows, SERIES), [], "v", [0.5], bins).first()
    assert np.isclose(whole["quantiles"][0], np.median([r[3] for r in rows if r[3] is not None]))


@pytest.mark.parametrize("scale", [1e-3, 1e9, 1e305])
def test_quantiles_at_any_range(spark, scale):
    """Values crowded at one end of a range that one far value, or an infinite one, makes wide."""
    rng = np.random.default_rng(1)
    crowd = (rng.random(3000) * scale).tolist() + [0.0, -0.0, scale * 100]
    rows = [("far", v) for v in [*crowd, -scale * 1000]] + [("infinite", v) for v in [*crowd, float("inf"), float("-inf")]]
    rows += [("odd", v) for v in (1.0, None, float("nan"), 1.0, 2.0)] + [(None, 7.0), (None, 8.0)]
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r["k"]: r["quantiles"] for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs, 64).collect()}
    for key in {k for k, _ in rows}:
        own = sorted(v for k, v in rows if k == key and v is not None and v == v)
        low, high = (np.array([own[int(f((len(own) - 1) * p))] for p in probs]) for f in (np.floor, np.ceil))
        share = np.array([(len(own) - 1) * p % 1 for p in probs])
        for made, a, b, part in zip(got[key], low, high, share):
            assert made == a if a == b else np.isclose(made, a + (b - a) * part, rtol=1e-9)


def test_latest_breaks_ties_by_id_and_ignores_the_partitioning(spark):
    rows = series(300)
    df = spark.createDataFrame(rows, SERIES)
    expected = {k: max((r[1], r[2]) for r in rows if r[0] == k)[1] for k in {r[0] for r in rows}}
    for parts in (1, 7):
        got = latest_per_key(df.repartition(parts), ["key"], ["ts", "id"], ["id"])
        assert {r["key"]: r["id"] for r in got.collect()} == expected
    recent = recent_per_key(df, ["key"], ["ts", "id"], 10).collect()
    assert all(sum(r["key"] == k for r in recent) == min(10, sum(r[0] == k for r in rows)) for k in expected)


def test_time_ranges_are_strict_below_and_closed_above(spark):
    as_of = F.lit(at(7200)).cast("timestamp")
    df = spark.createDataFrame([(at(s), s) for s in (0, 1, 3599, 3600, 3601, 7200)], "t timestamp, s long")
    assert [r["s"] for r in df.filter(since("t", as_of, 1)).collect()] == [3601, 7200]
    assert [r["s"] for r in df.filter(previous_period("t", as_of, 1)).collect()] == [1, 3599, 3600]
