"""Models trained and applied on the readings, with all their trees; what SQL can know of the result is compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.ingest import feature_rows
from checks.series import forecast_input
from checks.sql import SCORED, ts
from roadweave import fixed_values as fv
from roadweave.functions.lookups import congestion_level
from roadweave.models import congestion, isolation_forest
from roadweave.plans import forecast
from roadweave.session import checkpoint_dir

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


def _predicted(spark, path):
    rows = _stored(feature_rows(spark, path))
    return congestion.predict_congestion(congestion.train_congestion(rows), rows)


@query("m01_congestion_model", f"""with {SCORED}
select reading_id, location_name, congestion_level as actual_congestion, road_closure as predicted_closed, true as known_class from sc""")
def congestion_model(spark, path):
    """Ids, the actual class and the closure rule; a prediction is Closed exactly where the road is, and a class otherwise."""
    return _predicted(spark, path).select(
        "reading_id", "location_name", "actual_congestion", (F.col("predicted_congestion") == "Closed").alias("predicted_closed"),
        F.col("predicted_congestion").isin(fv.LEVELS).alias("known_class"))


@query("m01_congestion_model_quality", f"""with {SCORED}
select congestion_level as level, count(*) as rows, true as better_than_most_frequent from sc group by 1""")
def congestion_model_quality(spark, path):
    """Rows of each actual class, and whether the model is right more often than the most frequent class would be."""
    pairs = _predicted(spark, path).select("actual_congestion", "predicted_congestion")
    counted = pairs.groupBy(F.col("actual_congestion").alias("level")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("predicted_congestion") == F.col("actual_congestion")).alias("right"))
    every = counted.agg(F.sum("right").alias("right"), F.max("rows").alias("most"))
    return counted.withColumn("all", every.select(F.struct("right", "most")).scalar()).select(
        "level", "rows", (F.col("all.right") > F.col("all.most")).alias("better_than_most_frequent"))


def _stored(df):
    """Written once: fitting reads its rows in many passes."""
    path = f"{checkpoint_dir(df.sparkSession)}/models/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_LATER = f"""{SCORED}, ps as (select *, row_number() over (partition by location_name order by request_time, reading_id) as position,
    count(*) over (partition by location_name) as n from sc), lt as (select * from ps where position > floor(n * 0.5))"""


@query("m01_congestion_held_out", f"""with {_LATER} select congestion_level as level, count(*) as rows, true as better_than_most_frequent from lt group by 1""")
def congestion_held_out(spark, path):
    """Fitted on the earlier half of each road's readings, judged on the later: right more often than the class that was most frequent before."""
    earlier, later = map(_stored, congestion.time_split(_stored(feature_rows(spark, path)), gap_rows=0))
    pairs = congestion.predict_congestion(congestion.train_congestion(earlier), later).select("actual_congestion", "predicted_congestion")
    common = earlier.select(F.mode(congestion_level(F.col("congestion_ratio"), F.col("road_closure")), True)).scalar()
    counted = pairs.groupBy(F.col("actual_congestion").alias("level")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("predicted_congestion") == F.col("actual_congestion")).alias("right"))
    naive = F.sum(F.when(F.col("level") == common, F.col("rows")).otherwise(0))
    every = counted.agg((F.sum("right") > naive).alias("b")).scalar()
    return counted.select("level", "rows", every.alias("better_than_most_frequent"))


@query("m02_anomaly_scores", f"""with {SCORED}
select reading_id, location_name, true as among_the_strangest, true as flagged from sc where reading_id % 499 = 7""")
def anomaly_scores(spark, path):
    """Readings planted far from all others are among the lowest of all scores, and are flagged.

    The forest is fitted with them in; each reading is scored with all trees.
    """
    rows = feature_rows(spark, path)
    planted = F.col("reading_id") % 499 == 7
    # far from everything in every feature, on either side
    rows = rows.withColumns({c: F.when(planted, F.lit((-1) ** i * 5000)).otherwise(F.col(c)) for i, c in enumerate(fv.ANOMALY_FEATURES)})
    rows = _stored(rows)
    forest = isolation_forest.train(rows, "reading_id")
    found = _stored(isolation_forest.score(rows.select("reading_id", "location_name", "road_closure", *fv.ANOMALY_FEATURES), forest))
    found = found.withColumn("flag", isolation_forest.is_anomaly(F.col("anomaly_score"), F.col("road_closure"), F.col("speed_drop_pct")))
    # no reading that is not planted scores lower than the 99th part of them from below
    lowest = found.filter(~planted).agg(F.expr("percentile_approx(anomaly_score, 0.01, 10000)")).scalar()
    return found.filter(planted).select("reading_id", "location_name", (F.col("anomaly_score") < lowest).alias("among_the_strangest"), F.col("flag").alias("flagged"))


@query("m03_flagged_readings", f"""with {SCORED} select reading_id, true as by_the_rule from sc""")
def flagged_readings(spark, path):
    """The flag as stored against the rule written in SQL over the stored score; both outcomes occur."""
    rows = _stored(feature_rows(spark, path))
    found = _stored(isolation_forest.score(rows.select("reading_id", "road_closure", *fv.ANOMALY_FEATURES), isolation_forest.train(rows, "reading_id", trees=20)))
    flag = isolation_forest.is_anomaly(F.col("anomaly_score"), F.col("road_closure"), F.col("speed_drop_pct"))
    stored = found.withColumn("flag", flag)
    both = stored.agg(F.count_distinct("flag") == 2).scalar()
    rule = F.expr("CASE WHEN anomaly_score >= 0 THEN false WHEN road_closure THEN true WHEN speed_drop_pct > 30 THEN true ELSE anomaly_score < -0.05 END")
    return stored.select("reading_id", (F.col("flag").eqNullSafe(rule) & both).alias("by_the_rule"))


@query("m04_forecasts_held_out", """select * from (values ('20min', true, true), ('30min', true, true), ('60min', true, true)) v(horizon, speed_better_than_newest, class_better_than_most_frequent)""")
def forecasts_held_out(spark, path):
    """Fitted on the earlier rows of each road and judged on the later ones, with a gap as long as lags and horizons.

    Speeds: mean absolute error below that of the newest speed.  Classes: right more often than the class most frequent before.
    """
    placed = _stored(forecast_input(spark, path, ["road_closure", "position"]))
    earlier, later = congestion.time_split(_stored(congestion.with_targets(placed, placed=True)), share=0.35, placed=True)
    later = later.withColumnRenamed("current_speed", "_newest").withColumn("current_speed", F.col("_newest"))
    told = congestion.predict_forecasts(congestion.train_forecasts(earlier, trees=10, depth=3), later)
    common = earlier.agg(F.struct(*[F.mode(f"target_class_{horizon}", True).alias(horizon) for horizon in fv.HORIZON_MINUTES])).scalar()
    found = []
    for horizon in fv.HORIZON_MINUTES:  # all in one pass over what is told
        actual, level, said = F.col(f"target_speed_{horizon}"), F.col(f"target_class_{horizon}"), F.col("forecasts")[horizon]
        found.append(F.struct(
            F.lit(horizon).alias("horizon"),
            (F.avg(F.abs(said["speed"] - actual)) < F.avg(F.when(actual.isNotNull(), F.abs(F.col("_newest") - actual)))).alias("speed_better_than_newest"),
            (F.count_if(actual.isNotNull() & (said["class"] == level)) > F.count_if(actual.isNotNull() & (level == common[horizon]))).alias(
                "class_better_than_most_frequent")))
    return told.agg(F.array(*found).alias("found")).select(F.inline("found"))


@query("m04_speed_and_class_forecasts", f"""with {SCORED}, hz(horizon, ahead) as (values ('20min', 20), ('30min', 30), ('60min', 60)),
 wm as (select *, row_number() over (partition by location_name order by request_time, reading_id) as position from sc)
select {ts('request_time')} as forecast_made_at, location_name, horizon, {ts('request_time + to_minutes(ahead)')} as target_time,
  true as known_class, true as speed_within_range, true as confidence_within_range from wm, hz where position > 144""")
def speed_and_class_forecasts(spark, path):
    """A forecast of every reading with a full day behind it and every horizon, with its target time; classes and numbers within what was seen."""
    rows = _stored(forecast_input(spark, path, ["road_closure", "position"]))
    models = congestion.train_forecasts(congestion.with_targets(rows, placed=True))
    fastest = rows.agg(F.max("current_speed")).scalar()
    return forecast.forecast_table(congestion.predict_forecasts(models, rows)).select(
        "forecast_made_at", "location_name", "horizon", "target_time", F.col("predicted_class").isin(fv.LEVELS).alias("known_class"),
        # a boosted sum may overshoot what was seen, but not far
        F.col("predicted_speed").between(F.lit(-0.5) * fastest, F.lit(1.5) * fastest).alias("speed_within_range"),
        F.col("confidence").between(0, 1).alias("confidence_within_range"))
