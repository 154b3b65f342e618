"""Marts kept up to date without reading all history: sums by date and fine keys, folded into the five marts.

The fine sums hold everything the marts are made of in a form that adds up.  A refresh reads the facts of the dates that
changed, replaces these dates' sums and folds all marts from the sums, whose size depends on roads, hours and kinds of
weather, not on readings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import rounded
from roadweave.plans.marts import LEVEL, MARTS
from roadweave.sources.tables import _folder, save_mart

SUMS = "mart_sums"
MEANS = {"speed": "current_speed", "free_flow": "free_flow_speed", "ratio": "congestion_ratio", "temperature": "temperature", "rain": "rain_mm"}
ROAD = ["location_name", "district", "road_class"]
HOUR = ["hour", "time_period", "is_rush_hour", "day_name", "is_weekend"]
WEATHER = ["weather_condition", "temp_range", "rain_level", "visibility_impact"]
ADDED = [f"{name}_{part}" for name in MEANS for part in ("sum", "n")] + ["n", "closures"]


def fine_sums(facts: DataFrame) -> DataFrame:
    """One row per date, road, hour, weather and class; partial aggregates, so a task ships one row per group."""
    return facts.groupBy(F.to_date("event_time").alias("event_date"), *ROAD, *HOUR, *WEATHER, LEVEL).agg(
        *[how(column).alias(f"{name}_{part}") for name, column in MEANS.items() for part, how in (("sum", F.sum), ("n", F.count))],
        F.count(F.lit(1)).alias("n"), F.count_if("road_closure").alias("closures"),
        F.min("current_speed").alias("speed_min"), F.max("current_speed").alias("speed_max"))


def _folded(sums: DataFrame, keys: list[str], modes: list[str], *wanted: Column) -> DataFrame:
    """``wanted`` by ``keys``; ``<column>_top`` stands for the most frequent value of a column of ``modes``."""
    by_value = sums.groupBy(*keys, *modes).agg(
        *[F.sum(c).alias(c) for c in ADDED], F.min("speed_min").alias("speed_min"), F.max("speed_max").alias("speed_max"))
    for column in modes:
        often = F.sum("n").over(Window.partitionBy(*keys, column))
        # NULL is no value, ties go to the smallest
        by_value = by_value.withColumn(f"{column}_top", F.when(F.col(column).isNotNull(), F.struct(-often, F.col(column).alias("v"))))
    return by_value.groupBy(*keys).agg(*wanted)


def _mean(name: str, digits: int) -> Column:
    return rounded(F.sum(f"{name}_sum") / F.nullif(F.sum(f"{name}_n"), F.lit(0)), digits)


def _percent(condition: Column) -> Column:
    return rounded(F.sum(F.when(condition, F.col("n")).otherwise(0)) * F.lit(100.0) / F.sum("n"), 1)


def _top(column: str) -> Column:
    return F.min(f"{column}_top")["v"]


def hourly_traffic_summary(sums: DataFrame) -> DataFrame:
    counts = [F.sum(F.when(F.col(LEVEL) == level, F.col("n")).otherwise(0)).alias(level.lower().replace(" ", "_") + "_count") for level in fv.LEVELS]
    return _folded(
        sums, [*ROAD, *HOUR], [LEVEL], _mean("speed", 1).alias("avg_speed"), _mean("free_flow", 1).alias("avg_free_flow"),
        _mean("ratio", 3).alias("avg_congestion_ratio"), _mean("temperature", 1).alias("avg_temperature"), F.sum("n").alias("reading_count"),
        F.sum("closures").alias("closure_count"), *counts, _top(LEVEL).alias("dominant_congestion"))


def daily_congestion_report(sums: DataFrame) -> DataFrame:
    return _folded(
        sums.withColumnRenamed("event_date", "report_date"), ["report_date", *ROAD], [LEVEL, "weather_condition"],
        _mean("speed", 1).alias("avg_speed"), rounded(F.min("speed_min"), 1).alias("min_speed"), rounded(F.max("speed_max"), 1).alias("max_speed"),
        _mean("free_flow", 1).alias("avg_free_flow"), _mean("ratio", 3).alias("avg_congestion_ratio"), F.sum("n").alias("total_readings"),
        F.sum("closures").alias("closure_count"), _percent(F.col(LEVEL) != "Free Flow").alias("pct_congested"), _top(LEVEL).alias("dominant_congestion"),
        _mean("temperature", 1).alias("avg_temperature"), rounded(F.coalesce(F.sum("rain_sum"), F.lit(0.0)), 2).alias("total_rain_mm"),
        _top("weather_condition").alias("dominant_weather"))


def rush_hour_analysis(sums: DataFrame) -> DataFrame:
    return _folded(
        sums, [*ROAD, "is_rush_hour"], [LEVEL], _mean("speed", 1).alias("avg_speed"), _mean("ratio", 3).alias("avg_congestion_ratio"),
        F.sum("n").alias("reading_count"), _percent(F.col(LEVEL) == "Free Flow").alias("pct_free_flow"),
        _percent(F.col(LEVEL).isin("Heavy", "Severe", "Closed")).alias("pct_congested"))


def weather_impact_analysis(sums: DataFrame) -> DataFrame:
    clear = sums.filter("weather_condition = 'Clear'").agg(_mean("speed", 1).alias("v")).scalar()
    return _folded(
        sums, WEATHER, [LEVEL], _mean("speed", 1).alias("avg_speed"), _mean("ratio", 3).alias("avg_congestion_ratio"),
        _mean("temperature", 1).alias("avg_temperature"), _mean("rain", 2).alias("avg_rain_mm"), F.sum("n").alias("total_readings"),
        _percent(F.col(LEVEL) == "Free Flow").alias("pct_free_flow"), _percent(F.col(LEVEL).isin("Heavy", "Severe")).alias("pct_heavy_or_worse"),
    ).withColumn("speed_diff_from_clear", rounded(F.col("avg_speed") - clear, 1))


def district_overview(sums: DataFrame) -> DataFrame:
    roads = sums.groupBy("district").agg(F.count_distinct("location_name").alias("road_count"))
    found = _folded(
        sums, ["district"], [LEVEL], _mean("speed", 1).alias("avg_speed"), _mean("ratio", 3).alias("avg_congestion_ratio"),
        F.sum("n").alias("total_readings"), _percent(F.col(LEVEL) != "Free Flow").alias("pct_congested"), _top(LEVEL).alias("dominant_congestion"),
        _mean("temperature", 1).alias("avg_temperature"))
    return found.join(roads, found["district"].eqNullSafe(roads["district"])).drop(roads["district"]).select(
        "district", "road_count", *[c for c in found.columns if c != "district"])


FOLDS = {"hourly_traffic_summary": hourly_traffic_summary, "daily_congestion_report": daily_congestion_report,
         "rush_hour_analysis": rush_hour_analysis, "weather_impact_analysis": weather_impact_analysis, "district_overview": district_overview}


def changed_dates(spark: SparkSession, root: str, after_batch: int, table: str = "fact_traffic") -> list[date]:
    """Dates that batches after ``after_batch`` have added rows to; partition values only, no file is opened for them."""
    days = spark.read.parquet(f"{root}/{table}").filter(F.col("batch_id") > after_batch).select("event_date").distinct()
    return [r[0] for r in days.toLocalIterator()]


def refresh_marts(spark: SparkSession, facts_of: Callable[[list[date]], DataFrame], root: str, changed: Iterable[date]) -> dict[str, DataFrame]:
    """Bring the marts below ``root`` up to date.

    ``facts_of`` gives the enriched facts of some dates, and should read no others.  A changed date without facts loses its
    sums.  The first refresh names all dates.  Repeating a refresh gives the same marts.
    """
    days = sorted(set(changed))
    if days:
        # an old date goes first: one that has no facts left must not keep its sums
        for day in days:
            _folder(spark, f"{root}/{SUMS}/event_date={day.isoformat()}").delete()
        new = fine_sums(facts_of(days)).filter(F.col("event_date").isin(days))
        new.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(f"{root}/{SUMS}")
    held = spark.read.parquet(f"{root}/{SUMS}")
    for name, fold in FOLDS.items():
        keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in MARTS[name][1]]
        save_mart(fold(held).orderBy(*keys), root, name)
    return {name: spark.read.parquet(f"{root}/{name}") for name in FOLDS}
