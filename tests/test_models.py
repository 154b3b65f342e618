"""Models on small tables: they learn something, and metrics add up."""

import numpy as np
from pyspark.sql import functions as F

from checks.ingest import feature_rows
from roadweave.models import congestion, isolation_forest, metrics


def test_congestion_model_learns_and_closures_follow_the_rule(spark, small, tmp_path):
    rows = feature_rows(spark, small)
    model = congestion.train_congestion(rows, trees=10, depth=6)
    congestion.save_model(model, str(tmp_path / "model"))
    scored = congestion.predict_congestion(congestion.load_model(str(tmp_path / "model")), rows)
    assert scored.filter("road_closure and (predicted_congestion <> 'Closed' or actual_congestion <> 'Closed')").count() == 0
    quality = metrics.classification_metrics(scored, "actual_congestion", "predicted_congestion").first()
    assert quality["n"] == rows.count() and quality["accuracy"] > 0.9


def test_isolation_forest_finds_the_outliers(spark):
    draw = np.random.default_rng(1)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(draw.normal(size=(2000, 2)))] + [(5000, 9.0, 9.0), (5001, -8.0, 8.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    forest = isolation_forest.train(df, "id", ["x", "y"], trees=60)
    assert forest.groupBy("tree").count().filter("count > 511").count() == 0
    scored = isolation_forest.score(df, forest, ["x", "y"])
    worst = [r["id"] for r in scored.orderBy("anomaly_score").limit(2).collect()]
    assert sorted(worst) == [5000, 5001]
    assert scored.filter("id >= 5000 and anomaly_score >= 0").count() == 0
    again = isolation_forest.score(df.repartition(5), isolation_forest.train(df.repartition(3), "id", ["x", "y"], trees=60), ["x", "y"])
    assert scored.join(again.withColumnRenamed("anomaly_score", "b"), "id").filter(F.abs(F.col("anomaly_score") - F.col("b")) > 1e-9).count() == 0


def test_anomaly_needs_a_signal(spark):
    rows = [(-0.06, False, 0.0), (-0.05, False, 30.0), (-0.01, True, 0.0), (-0.01, None, 30.1), (0.0, True, 90.0)]
    df = spark.createDataFrame(rows, "s double, c boolean, d double")
    got = df.select(isolation_forest.is_anomaly(F.col("s"), F.col("c"), F.col("d")).alias("a")).collect()
    assert [r["a"] for r in got] == [True, False, True, True, False]


def test_mean_path_of_small_trees():
    assert isolation_forest.mean_path([1, 2]).tolist() == [0.0, 1.0]
    assert abs(float(isolation_forest.mean_path(256)) - 10.2448) < 1e-3
