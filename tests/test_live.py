"""Keyed tables, commits, and the live pipeline when a batch fails midway."""

import uuid

import pytest
from pyspark.sql import functions as F

from checks import tables as t
from checks.ingest import feature_rows, statistics
from roadweave import fixed_values as fv
from roadweave.functions.geo import with_message_district
from roadweave.models import congestion, isolation_forest
from roadweave.plans import features
from roadweave.session import checkpoint_dir
from roadweave.sources import keyed
from roadweave.sources.tables import _folder
from roadweave.streaming import live

ROW = "name string, n long"


@pytest.fixture
def root(spark):
    return f"{checkpoint_dir(spark)}/tests/{uuid.uuid4().hex}"


def put(spark, table, rows, batch):
    """Sum by name."""
    new = spark.createDataFrame(rows, ROW)
    before = keyed.read_commit(spark, table.root, batch - 1)
    commit = before.following(batch)
    touched = table.touched(new)
    table.write(new.unionByName(table.read(spark, before, touched)).groupBy("name").agg(F.sum("n").alias("n")), touched, commit)
    return commit, before


def content(spark, table):
    return {r["name"]: r["n"] for r in table.read(spark, keyed.read_commit(spark, table.root)).collect()}


def test_untouched_buckets_keep_their_files(spark, root):
    table = keyed.KeyedTable(root, "sums", ["name"], ROW, buckets=8)
    names = [f"road {i}" for i in range(40)]
    keyed.write_commit(spark, root, *put(spark, table, [(n, 1) for n in names], 0))
    before = keyed.read_commit(spark, root).buckets["sums"]
    keyed.write_commit(spark, root, *put(spark, table, [("road 3", 5)], 1))
    after = keyed.read_commit(spark, root).buckets["sums"]
    assert sum(before[b] != after[b] for b in after) == 1 and set(before) == set(after)
    assert len(_folder(spark, f"{root}/sums/version=1").children()) == 2  # one bucket and the mark of success
    assert content(spark, table) == dict.fromkeys(names, 1) | {"road 3": 6}
    # what batch 1 replaced goes when batch 2 is committed
    keyed.write_commit(spark, root, *put(spark, table, [("road 4", 1)], 2))
    gone = {f"bucket={b}" for b in after if after[b] != before[b]}
    assert not gone & set(_folder(spark, f"{root}/sums/version=0").children())
    assert content(spark, table) == dict.fromkeys(names, 1) | {"road 3": 6, "road 4": 2}


def test_a_batch_counts_once_and_only_when_committed(spark, root):
    table = keyed.KeyedTable(root, "sums", ["name"], ROW, buckets=4)
    assert content(spark, table) == {}
    keyed.write_commit(spark, root, *put(spark, table, [("a", 1), ("b", 2)], 0))
    put(spark, table, [("a", 10)], 1)  # fails before its commit
    assert content(spark, table) == {"a": 1, "b": 2}
    for _ in range(2):  # repeated after its commit, too
        keyed.write_commit(spark, root, *put(spark, table, [("a", 10), ("c", 3)], 1))
    assert content(spark, table) == {"a": 11, "b": 2, "c": 3}


@pytest.fixture(scope="module")
def models(spark, small):
    rows, plain = feature_rows(spark, small), t.readings(spark, small)
    numbers = [F.rand(i).alias(c) for i, c in enumerate(fv.FORECAST_FEATURES)]
    targets = [(F.rand(9) * 50).alias(f"target_speed_{h}") for h in fv.HORIZON_MINUTES]
    targets += [F.when(F.rand(8) < 0.5, "Heavy").otherwise("Severe").alias(f"target_class_{h}") for h in fv.HORIZON_MINUTES]
    folder = f"{checkpoint_dir(spark)}/tests/{uuid.uuid4().hex}"
    isolation_forest.train(rows, "reading_id", trees=5).write.parquet(f"{folder}/forest")
    features.class_index(plain, "frc").write.parquet(f"{folder}/frc")
    features.class_index(with_message_district(plain), "district").write.parquet(f"{folder}/district")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return live.Models(read("forest"), congestion.train_congestion(rows, trees=2, depth=3),
                       congestion.train_forecasts(spark.range(60).select(*numbers, *targets), trees=1, depth=1), statistics(spark, small),
                       read("frc"), read("district"))


def test_a_batch_that_fails_midway_is_seen_in_no_table_and_repeated_whole(spark, small, root, models, monkeypatch):
    messages = t.messages(spark, small).drop("arrived_at").filter("request_time < '2024-01-03'").cache()
    first, second = messages.filter("reading_id % 2 = 0"), messages.filter("reading_id % 2 = 1")
    pipeline = live.Live(root, models, live.Settings(t.as_of(), 3600, lateness_seconds=10**7))
    pipeline.write(first, 0)

    def seen():
        commit = keyed.read_commit(spark, root)
        counts = {name: keyed.committed(spark, root, name, commit).count() for name in ("data_quality_events", "predictions")}
        return counts | {r["location_name"]: r["reading_id"] for r in pipeline.latest.read(spark, commit).collect()}

    before = seen()
    assert before["data_quality_events"] == first.count() > 0

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(pipeline, "_alerts", fail)
        with pytest.raises(RuntimeError):
            pipeline.write(second, 1)
    assert spark.read.parquet(f"{root}/predictions").count() > before["predictions"]  # written, but not to be seen
    assert seen() == before
    pipeline.write(second, 1)
    after = seen()
    assert after["data_quality_events"] == messages.count()
    predicted = keyed.committed(spark, root, "predictions")
    assert after["predictions"] == predicted.select("prediction_id").distinct().count()
    timed = predicted.join(messages.select(F.col("reading_id").alias("prediction_id"), F.try_to_timestamp("request_time").alias("at")), "prediction_id")
    newest = timed.filter("at IS NOT NULL").groupBy("location_name").agg(F.max_by("prediction_id", F.struct("at", "prediction_id")).alias("n"))
    assert {r["location_name"]: r["n"] for r in newest.collect()} == {k: v for k, v in after.items() if k.startswith("Road")}
