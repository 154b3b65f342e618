"""Trees grown on binned rows against Spark ML's own trainers and plain loops."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.models import congestion, isolation_forest, trees

NAMES = ["a", "b", "c"]


def _points(spark, rows=3000, parts=5):
    draw = np.random.default_rng(3)
    a, b, c = draw.integers(0, 12, rows), draw.normal(size=rows), draw.integers(0, 3, rows)
    y = np.where(a > 6, 10.0, 0.0) + 3 * b + c
    values = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), "high" if y[i] > 8 else "mid" if y[i] > 2 else "low") for i in range(rows)]
    return spark.createDataFrame(values, "id long, a double, b double, c double, y double, k string").repartition(parts, "id").localCheckpoint()


def _fit(rows, stages, label):
    cuts = trees.thresholds(rows, NAMES)
    return Pipeline(stages=stages(cuts)).fit(trees.binned(rows, NAMES, cuts, [label]))


def test_cuts_lie_between_values_and_hold_equal_shares(spark):
    rows = _points(spark)
    a, b, c = trees.thresholds(rows, NAMES)
    assert a.tolist() == [x + 0.5 for x in range(11)] and c.tolist() == [0.5, 1.5] and len(b) == 31
    told = trees.binned(rows, NAMES, [a, b, c], ["id"]).join(rows, "id").collect()
    for r in told:
        assert list(r["_bins"]) == [int(r["a"]), int((b < r["b"]).sum()), int(r["c"])]
    shares = np.bincount([r["_bins"][1] for r in told])
    assert len(shares) == 32 and 0.7 < shares.min() / (3000 / 32) and shares.max() / (3000 / 32) < 1.3
    assert trees.thresholds(rows.select(F.lit(4.0).alias("a")), ["a"])[0].tolist() == []
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "a double")
    assert trees.thresholds(ends, ["a"])[0].tolist() == [float("-inf"), 1.0]


def test_boosted_trees_tell_what_those_of_spark_tell(spark):
    rows = _points(spark)
    ours = _fit(rows, lambda cuts: [trees.BoostedTrees(cuts, featuresCol="f", labelCol="y", predictionCol="p", maxIter=8, maxDepth=4, seed=1)], "y").stages[-1]
    vectors = VectorAssembler(inputCols=NAMES, outputCol="f").transform(rows)
    theirs = GBTRegressor(featuresCol="f", labelCol="y", predictionCol="q", maxIter=8, maxDepth=4, seed=1).fit(vectors)
    both = theirs.transform(ours.transform(vectors)).select("y", "p", "q").toPandas()
    error = lambda c: ((both["y"] - both[c]) ** 2).mean()
    assert ours.getNumTrees == 8 and list(ours.treeWeights) == [1.0] + [0.1] * 7
    assert error("p") < 1.1 * error("q") and np.corrcoef(both["p"], both["q"])[0, 1] > 0.995


def test_a_tree_is_the_best_of_all_splits_at_each_node(spark):
    rows = _points(spark, 400, 3).withColumn("b", F.round("b", 0)).localCheckpoint()  # few values, so bins are exact
    model = _fit(rows, lambda cuts: [trees.BoostedTrees(cuts, featuresCol="f", labelCol="y", predictionCol="p", maxIter=1, maxDepth=3)], "y").stages[-1]
    data = rows.select(*NAMES, "y").toPandas().to_numpy()

    def grow(part, depth):
        x, y = part[:, :3], part[:, 3]
        best = (1e-9, None)
        for j in range(3):
            for t in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= t
                gain = y.var() - sum(m.mean() * y[m].var() for m in (left, ~left))
                best = max(best, (gain, (j, t)), key=lambda g: g[0])
        if depth == 3 or best[1] is None:
            return lambda row: y.mean()
        j, t = best[1]
        low, high = grow(part[x[:, j] <= t], depth + 1), grow(part[x[:, j] > t], depth + 1)
        return lambda row: low(row) if row[j] <= t else high(row)

    tell = grow(data, 0)
    told = model.transform(VectorAssembler(inputCols=NAMES, outputCol="f").transform(rows)).select(*NAMES, "p").toPandas().to_numpy()
    assert all(abs(tell(r[:3]) - r[3]) < 1e-9 for r in told)


def test_class_forest_is_as_right_as_that_of_spark_and_can_be_saved(spark, tmp_path):
    rows = _points(spark)
    index = congestion._classifier(NAMES, cuts := trees.thresholds(rows, NAMES), "k", 12, 5, 42)
    model = index.fit(trees.binned(rows, NAMES, cuts, ["k"]))
    congestion.save_model(model, str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    told = loaded.transform(rows).select("id", "_label", "_class", "_probability").collect()
    again = {r["id"]: r["_class"] for r in model.transform(rows).collect()}
    assert all(again[r["id"]] == r["_class"] and abs(sum(r["_probability"]) - 1) < 1e-9 for r in told)
    right = np.mean([r["_label"] == r["_class"] for r in told])
    vectors = model.stages[0].transform(VectorAssembler(inputCols=NAMES, outputCol="f").transform(rows))
    theirs = RandomForestClassifier(featuresCol="f", labelCol="_label", numTrees=12, maxDepth=5, seed=42).fit(vectors)
    other = theirs.transform(vectors).select((F.col("prediction") == F.col("_label")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert model.stages[0].labels == ["high", "low", "mid"] and model.stages[-1].getNumTrees == 12 and right > other - 0.03


def test_one_value_one_class_and_no_rows(spark):
    one = spark.range(50).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(3.0).alias("c"), F.lit(5.5).alias("y"), F.lit("k").alias("k"))
    speed = _fit(one, lambda cuts: [trees.BoostedTrees(cuts, featuresCol="f", labelCol="y", predictionCol="p", maxIter=3, maxDepth=2)], "y").stages[-1]
    told = speed.transform(VectorAssembler(inputCols=NAMES, outputCol="f").transform(one)).select("p").distinct().collect()
    assert [r["p"] for r in told] == [5.5]
    with pytest.raises(ValueError):
        _fit(one.limit(0), lambda cuts: [trees.BoostedTrees(cuts, featuresCol="f", labelCol="y", predictionCol="p", maxIter=3, maxDepth=2)], "y")


def test_fits_read_rows_of_bytes_and_no_vectors(spark, monkeypatch):
    rows = spark.range(300).select(
        "id", *[(F.rand(i) * 9).alias(c) for i, c in enumerate(fv.FORECAST_FEATURES)], *[(F.rand(9) * 50).alias(f"target_speed_{h}") for h in fv.HORIZON_MINUTES],
        *[F.when(F.rand(8) < 0.5, "Heavy").otherwise("Severe").alias(f"target_class_{h}") for h in fv.HORIZON_MINUTES]).localCheckpoint()
    seen, fit = [], congestion.Pipeline.fit
    monkeypatch.setattr(congestion.Pipeline, "fit", lambda self, df: seen.append(df.columns) or fit(self, df))
    monkeypatch.setattr(congestion.VectorAssembler, "transform", lambda self, df, params=None: pytest.fail("a vector for each row"))
    congestion.train_forecasts(rows, trees=2, depth=2)
    assert len(seen) == 6 and all(trees.BINS in columns and not set(fv.FORECAST_FEATURES) & set(columns) for columns in seen)


def test_scores_are_those_of_a_walk_down_each_tree(spark):
    columns = fv.ANOMALY_FEATURES
    rows = spark.range(700).select("id", *[F.round(F.rand(i) * 9, 0).alias(c) for i, c in enumerate(columns)]).localCheckpoint()  # values on thresholds, too
    forest = isolation_forest.train(rows, "id", trees=4, sample_rows=64).localCheckpoint()
    trees_ = [g.sort_values("node").to_dict("records") for _, g in forest.toPandas().groupby("tree")]

    def depth(nodes, row):
        node = nodes[0]
        while node["feature"] >= 0:
            node = nodes[node["left"] if row[columns[node["feature"]]] < node["threshold"] else node["right"]]
        return node["depth"] + float(isolation_forest.mean_path(node["size"]))

    sample = float(isolation_forest.mean_path(64))
    for row in isolation_forest.score(rows, forest).collect():
        assert abs(row["anomaly_score"] - (0.5 - 2.0 ** (-np.mean([depth(nodes, row) for nodes in trees_]) / sample))) < 1e-12


def test_many_tasks_give_the_same_trees(spark, monkeypatch):
    rows = _points(spark, 900, 6).withColumn("b", F.round("b", 0)).localCheckpoint()
    fit = lambda: _fit(rows, lambda cuts: [trees.BoostedTrees(cuts, featuresCol="f", labelCol="y", predictionCol="p", maxIter=2, maxDepth=3)], "y").stages[-1]
    few, cuts = fit().toDebugString.split("\n", 1)[1], trees.thresholds(rows, NAMES)
    monkeypatch.setattr(trees, "COLLECTED", 2)  # partial sums are added up in tasks first
    many = fit().toDebugString.split("\n", 1)[1]
    numbers = lambda text: [line.rsplit(" ", 1)[0] if "Predict" in line else line for line in text.split("\n")]
    assert numbers(many) == numbers(few) and all(np.array_equal(a, b) for a, b in zip(cuts, trees.thresholds(rows, NAMES), strict=True))
