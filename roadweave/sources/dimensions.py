"""Dimension tables: seeds, reads and insert-if-absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions import lookups
from roadweave.operators.sizing import broadcast_if_small


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small fixed list as a table whose size the planner knows, so joins with it are broadcast."""
    def shown(value):
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else (
            f"{value}D" if isinstance(value, float) else str(value))

    lines = ", ".join("(" + ", ".join(map(shown, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({', '.join(columns)})")


def seed_locations(spark: SparkSession) -> DataFrame:
    rows = [(i, *road) for i, road in enumerate(fv.SEED_ROADS, start=1)]
    return literal_table(spark, rows, ["location_key", "location_name", "lat", "lon", "district", "road_class"])


def seed_times(spark: SparkSession) -> DataFrame:
    """Every hour of every weekday: 168 rows out of one range, Sunday = 0."""
    hour, day = F.floor(F.col("id") / 7).cast("int"), (F.col("id") % 7).cast("int")
    return spark.range(24 * 7, numPartitions=1).select(
        (F.col("id") + 1).cast("int").alias("time_key"),
        hour.alias("hour"),
        day.alias("day_of_week"),
        F.get(F.array(*map(F.lit, fv.DAY_NAMES)), day).alias("day_name"),
        day.isin(5, 6).alias("is_weekend"),
        lookups.is_rush_hour(hour).alias("is_rush_hour"),
        lookups.time_period_name(hour).alias("time_period"),
    )


def seed_weather(spark: SparkSession) -> DataFrame:
    rows = [(i, *w) for i, w in enumerate(fv.SEED_WEATHER, start=1)]
    return literal_table(spark, rows, ["weather_key", "condition", "temp_range", "rain_level", "visibility_impact"])


DIMENSION_KEYS = {
    "dim_location": ["location_key", "location_name"],
    "dim_time": ["time_key", "hour", "day_of_week"],
    "dim_weather": ["weather_key", "condition"],
}


def read_dimensions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three dimensions cut down to surrogate and natural key."""
    return {name: spark.read.parquet(f"{path}/{name}").select(*keys) for name, keys in DIMENSION_KEYS.items()}


def read_dimensions_jdbc(spark: SparkSession, url: str, schema: str = "warehouse", **properties: str) -> dict[str, DataFrame]:
    """The same from a database, whose tables have no size the planner knows: it is counted."""
    return {
        name: broadcast_if_small(spark.read.jdbc(url, f"{schema}.{name}", properties=properties).select(*keys))
        for name, keys in DIMENSION_KEYS.items()
    }


def absent_rows(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose natural key ``existing`` lacks; one row per key."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return existing.unionByName(absent_rows(new, existing, key))

