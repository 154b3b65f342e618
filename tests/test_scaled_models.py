"""Rows that are read, numbered, assembled and scored no more often than needed, with the same results."""

import numpy as np
from pyspark.sql import functions as F

from checks import tables as t
from roadweave import fixed_values as fv
from roadweave.models import congestion, isolation_forest
from roadweave.operators.lags import with_lags


def test_a_scan_of_one_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).selectExpr("id AS event_id", "id % 7 AS user_id", "id % 3 AS value").coalesce(1).write.parquet(f"{tmp_path}/e")
    scan = spark.read.parquet(f"{tmp_path}/e")
    dealt = t.spread(scan)
    assert scan.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(scan).count() == 0 and dealt.count() == 1000


def test_a_micro_batch_has_the_same_number_of_files_for_each_core():
    assert [t.stream_files(rows, 12) for rows in (50, 150_000, 3_000_000, 18_000_000, 30_000_000)] == [4, 6, 12, 12, 24]


def _series(spark):
    rows = spark.range(2000).selectExpr(
        "id AS reading_id", "concat('Road ', id % 3) AS location_name", "timestamp_seconds(id * 600) AS event_time", "id * 1.0D AS current_speed",
        "(id % 10) / 10D AS congestion_ratio", "id % 50 = 0 AS road_closure")
    return with_lags(rows, ["location_name"], "event_time", "reading_id", {}).filter("position > 144").localCheckpoint()


def test_placed_rows_have_the_same_targets_and_the_same_split(spark):
    placed = _series(spark)
    told = congestion.with_targets(placed, placed=True).localCheckpoint()
    plain = congestion.with_targets(placed.drop("position")).localCheckpoint()
    assert told.drop("position").exceptAll(plain.select(*told.drop("position").columns)).count() == 0 and told.count() == plain.count() == 2000 - 3 * 144
    for a, b in zip(congestion.time_split(told, 0.35, 51, placed=True), congestion.time_split(plain, 0.35, 51), strict=True):
        ids = [sorted(r[0] for r in df.select("reading_id").collect()) for df in (a, b)]
        assert ids[0] == ids[1] and ids[0]
    assert "Window" not in congestion.time_split(told, placed=True)[0]._jdf.queryExecution().toString()


def test_the_features_of_a_forecast_are_assembled_once(spark, monkeypatch):
    rows = spark.range(80).select(
        "id", *[(F.rand(i) * 9).alias(c) for i, c in enumerate(fv.FORECAST_FEATURES)], *[(F.rand(9) * 50).alias(f"target_speed_{h}") for h in fv.HORIZON_MINUTES],
        *[F.when(F.rand(8) < 0.5, "Heavy").otherwise("Severe").alias(f"target_class_{h}") for h in fv.HORIZON_MINUTES]).localCheckpoint()
    models = congestion.train_forecasts(rows, trees=2, depth=2)
    calls, assemble = [], congestion.VectorAssembler.transform
    with monkeypatch.context() as patched:
        patched.setattr(congestion.VectorAssembler, "transform", lambda self, df: calls.append(1) or assemble(self, df))
        told = congestion.predict_forecasts(models, rows)
    assert len(calls) == 1
    found = {r["id"]: r["forecasts"] for r in told.collect()}
    for horizon, (speed_model, class_model) in models.items():  # each model with its own assembler
        alone = class_model.transform(speed_model.transform(rows.drop("_features")).drop("_features")).collect()
        for r in alone:
            assert abs(found[r["id"]][horizon]["speed"] - r["_speed"]) <= 0.051
            assert found[r["id"]][horizon]["class"] == class_model.stages[0].labels[int(r["_class"])]


def test_only_the_columns_of_the_forest_go_to_python(spark):
    columns = {c: (F.rand(i) * 9).alias(c) for i, c in enumerate(fv.ANOMALY_FEATURES)}
    rows = spark.range(300).select("id", F.lit("text").alias("note"), *columns.values()).withColumn(
        fv.ANOMALY_FEATURES[0], F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).when(F.col("id") % 9 > 1, F.col(fv.ANOMALY_FEATURES[0]))).localCheckpoint()
    forest = isolation_forest.train(rows, "id", trees=3).localCheckpoint()
    scored = isolation_forest.score(rows, forest)
    plan = scored._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and scored.columns == [*rows.columns, "anomaly_score"]
    nothing = isolation_forest.score(rows.fillna(0.0), forest)  # null and NaN count as 0
    a, b = ({r["id"]: r["anomaly_score"] for r in df.collect()} for df in (scored, nothing))
    assert a == b and len(a) == 300 and np.ptp(list(a.values())) > 0
