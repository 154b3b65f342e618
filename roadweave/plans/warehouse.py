"""Readings into the star schema and back out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import lookups

FACT_COLUMNS = [
    "event_time", "location_key", "time_key", "weather_key", "current_speed", "free_flow_speed",
    "congestion_ratio", "road_closure", "confidence", "temperature", "rain_mm", "humidity", "wind_speed",
]


def enrich_readings(readings: DataFrame) -> DataFrame:
    """Columns the key lookups need; an unreadable time stays NULL."""
    return (
        readings
        .withColumn("event_time", lookups.instant(readings, "request_time"))
        .withColumns({
            "congestion_ratio": lookups.congestion_ratio(F.col("current_speed"), F.col("free_flow_speed")),
            "hour": F.hour("event_time"),
            "day_of_week": lookups.sunday_first(F.col("event_time")),
        })
        .withColumnRenamed("weather_main", "condition")
    )


def lookup_keys(enriched: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Natural keys -> surrogate keys; an unknown natural key leaves a NULL.

    The dimensions come from files or fixed lists, so the planner knows their size and picks
    a broadcast below its threshold and a shuffle join (with skew handling) above it.
    """
    location = dimensions["dim_location"].select("location_key", "location_name")
    time = dimensions["dim_time"].select("time_key", "hour", "day_of_week")
    weather = dimensions["dim_weather"].select("weather_key", "condition")
    return (
        enriched.join(location, "location_name", "left")
        .join(time, ["hour", "day_of_week"], "left")
        .join(weather, "condition", "left")
    )


def fact_rows(readings: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """The 13 fact columns of a batch of readings."""
    return (
        lookup_keys(enrich_readings(readings), dimensions)
        .withColumnsRenamed({
            "weather_temp": "temperature", "weather_rain": "rain_mm",
            "weather_humid": "humidity", "weather_wind": "wind_speed",
        })
        .select(*FACT_COLUMNS)
    )


def enriched_facts(fact: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Fact joined with its dimensions plus the congestion class: the base of every mart."""
    weather = dimensions["dim_weather"].withColumnRenamed("condition", "weather_condition")
    return (
        fact.join(dimensions["dim_location"], "location_key", "left")
        .join(dimensions["dim_time"], "time_key", "left")
        .join(weather, "weather_key", "left")
        .select(
            "event_time", "current_speed", "free_flow_speed", "congestion_ratio", "road_closure",
            "confidence", "temperature", "rain_mm", "humidity", "wind_speed",
            "location_name", "district", "road_class", "lat", "lon",
            "hour", "day_of_week", "day_name", "is_weekend", "is_rush_hour", "time_period",
            "weather_condition", "temp_range", "rain_level", "visibility_impact",
            lookups.congestion_level(F.col("congestion_ratio"), F.col("road_closure")).alias("congestion_level"),
        )
    )
