"""The five marts over ``enriched_facts``.

All measures are partial aggregates: a task ships one row per group, never readings.
``mode`` keeps a count per value, and the values are five classes or a dozen conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import percent_of, rounded
from roadweave.sources.tables import save_mart

LEVEL = "congestion_level"


def _avg(column: str, digits: int) -> Column:
    return rounded(F.avg(column), digits)


def _mode(column: str) -> Column:
    """Most frequent value, NULL ignored, ties to the smallest."""
    return F.mode(column, deterministic=True)


def _rows() -> Column:
    return F.count(F.lit(1))


def hourly_traffic_summary(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy("location_name", "district", "road_class", "hour", "time_period",
                      "is_rush_hour", "day_name", "is_weekend")
        .agg(
            _avg("current_speed", 1).alias("avg_speed"),
            _avg("free_flow_speed", 1).alias("avg_free_flow"),
            _avg("congestion_ratio", 3).alias("avg_congestion_ratio"),
            _avg("temperature", 1).alias("avg_temperature"),
            _rows().alias("reading_count"),
            F.count_if("road_closure").alias("closure_count"),
            *[F.count_if(F.col(LEVEL) == level).alias(level.lower().replace(" ", "_") + "_count")
              for level in fv.LEVELS],
            _mode(LEVEL).alias("dominant_congestion"),
        )
    )


def daily_congestion_report(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy(F.to_date("event_time").alias("report_date"), "location_name", "district", "road_class")
        .agg(
            _avg("current_speed", 1).alias("avg_speed"),
            rounded(F.min("current_speed"), 1).alias("min_speed"),
            rounded(F.max("current_speed"), 1).alias("max_speed"),
            _avg("free_flow_speed", 1).alias("avg_free_flow"),
            _avg("congestion_ratio", 3).alias("avg_congestion_ratio"),
            _rows().alias("total_readings"),
            F.count_if("road_closure").alias("closure_count"),
            percent_of(F.col(LEVEL) != "Free Flow").alias("pct_congested"),
            _mode(LEVEL).alias("dominant_congestion"),
            _avg("temperature", 1).alias("avg_temperature"),
            rounded(F.sum(F.coalesce("rain_mm", F.lit(0.0))), 2).alias("total_rain_mm"),
            _mode("weather_condition").alias("dominant_weather"),
        )
    )


def rush_hour_analysis(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy("location_name", "district", "road_class", "is_rush_hour")
        .agg(
            _avg("current_speed", 1).alias("avg_speed"),
            _avg("congestion_ratio", 3).alias("avg_congestion_ratio"),
            _rows().alias("reading_count"),
            percent_of(F.col(LEVEL) == "Free Flow").alias("pct_free_flow"),
            percent_of(F.col(LEVEL).isin("Heavy", "Severe", "Closed")).alias("pct_congested"),
        )
    )


def weather_impact_analysis(facts: DataFrame) -> DataFrame:
    """Per weather category, with the difference to the mean speed under a clear sky.

    The baseline is summed up from the grouped rows (a few dozen), so the facts are read once.
    """
    everything = Window.partitionBy()
    clear = F.col("weather_condition") == "Clear"
    clear_mean = F.sum(F.when(clear, F.col("_sum"))).over(everything) / F.nullif(
        F.sum(F.when(clear, F.col("_n"))).over(everything), F.lit(0))
    return (
        facts.groupBy("weather_condition", "temp_range", "rain_level", "visibility_impact")
        .agg(
            _avg("current_speed", 1).alias("avg_speed"),
            _avg("congestion_ratio", 3).alias("avg_congestion_ratio"),
            _avg("temperature", 1).alias("avg_temperature"),
            _avg("rain_mm", 2).alias("avg_rain_mm"),
            _rows().alias("total_readings"),
            percent_of(F.col(LEVEL) == "Free Flow").alias("pct_free_flow"),
            percent_of(F.col(LEVEL).isin("Heavy", "Severe")).alias("pct_heavy_or_worse"),
            F.sum("current_speed").alias("_sum"),
            F.count("current_speed").alias("_n"),
        )
        .withColumn("speed_diff_from_clear", rounded(F.col("avg_speed") - rounded(clear_mean, 1), 1))
        .drop("_sum", "_n")
    )


def district_overview(facts: DataFrame) -> DataFrame:
    """Per district.  Rolled up from per-road sums, so the distinct road count costs nothing extra."""
    levels = facts.groupBy("district", "location_name", LEVEL).agg(
        F.sum("current_speed").alias("speed_sum"), F.count("current_speed").alias("speed_n"),
        F.sum("congestion_ratio").alias("ratio_sum"), F.count("congestion_ratio").alias("ratio_n"),
        F.sum("temperature").alias("temp_sum"), F.count("temperature").alias("temp_n"),
        _rows().alias("n"),
    )
    per_level = Window.partitionBy("district", LEVEL)

    def mean(name, digits):
        return rounded(F.sum(f"{name}_sum") / F.nullif(F.sum(f"{name}_n"), F.lit(0)), digits)

    return (
        levels.withColumn("level_n", F.sum("n").over(per_level))
        .groupBy("district")
        .agg(
            F.countDistinct("location_name").alias("road_count"),
            mean("speed", 1).alias("avg_speed"),
            mean("ratio", 3).alias("avg_congestion_ratio"),
            F.sum("n").alias("total_readings"),
            rounded(F.sum(F.when(F.col(LEVEL) != "Free Flow", F.col("n")).otherwise(0)) * F.lit(100.0) / F.sum("n"), 1)
            .alias("pct_congested"),
            # most frequent level, ties to the alphabetically smallest
            F.min(F.struct(-F.col("level_n"), F.col(LEVEL)))[LEVEL].alias("dominant_congestion"),
            mean("temp", 1).alias("avg_temperature"),
        )
    )


MARTS = {
    "hourly_traffic_summary": (hourly_traffic_summary, ["location_name", "hour"]),
    "daily_congestion_report": (daily_congestion_report, ["-report_date", "avg_congestion_ratio"]),
    "rush_hour_analysis": (rush_hour_analysis, ["location_name", "is_rush_hour"]),
    "weather_impact_analysis": (weather_impact_analysis, ["avg_congestion_ratio"]),
    "district_overview": (district_overview, ["avg_congestion_ratio"]),
}


def build_marts(facts: DataFrame, root: str) -> dict[str, DataFrame]:
    """Rebuild every mart in full and register the staging view."""
    facts.createOrReplaceTempView("stg_traffic_enriched")
    spark = facts.sparkSession
    for name, (build, order) in MARTS.items():
        keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
        save_mart(build(facts).orderBy(*keys), root, name)
    return {name: spark.read.parquet(f"{root}/{name}") for name in MARTS}
