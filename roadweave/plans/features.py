"""The 23-column feature row of the congestion and anomaly models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions import features as ft
from roadweave.functions.geo import with_district, with_message_district
from roadweave.operators.sizing import broadcast_if_small
from roadweave.plans import stats as st
from roadweave.session import checkpoint_dir


def class_index(readings: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with their 0-based index: the label encoding of ``column``.

    The values are dealt by range, numbered within their range, and moved up by the counts of the ranges before.
    The distinct values are checkpointed, as their ranges must not change between the count and the numbering.
    """
    checkpoint_dir(readings.sparkSession)
    values = (
        readings.select(column).filter(F.col(column).isNotNull()).distinct()
        .repartitionByRange(column).withColumn("_range", F.spark_partition_id()).checkpoint()
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = values.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return values.withColumn("_within", within).join(offsets, "_range").select(
        column, (F.col("_offset") + F.col("_within") - 1).cast("int").alias("index"))


def encode(df: DataFrame, column: str, index: DataFrame, unknown: int, name: str) -> DataFrame:
    codes = broadcast_if_small(index.select(F.col(column), F.col("index").alias("_index")))
    return df.join(codes, column, "left").withColumn(name, F.coalesce("_index", F.lit(unknown))).drop("_index")


def traffic_features(readings: DataFrame, stats: DataFrame, frc_index: DataFrame, as_of: Column) -> DataFrame:
    """Raw readings -> model features.

    One pass over the readings: projections plus lookups in small tables, no shuffle of the
    readings themselves as long as those tables stay within the checked broadcast size.
    """
    df = ft.with_weather_features(ft.with_time_features(ft.with_base_features(readings), as_of))
    df = st.with_location_stats(with_message_district(with_district(df, output="_place")), stats)
    df = df.withColumns({
        "loc_avg_speed": F.col("stats.avg_speed"),
        "loc_avg_congestion": F.col("stats.avg_congestion_ratio"),
        "speed_deviation": F.col("current_speed") - F.col("stats.avg_speed"),
        "is_slow_road": (F.col("free_flow_speed") < 25).cast("int"),
        "road_closure_int": F.coalesce("road_closure", F.lit(False)).cast("int"),
    }).drop("stats")
    df = encode(st.with_district_target(df, stats), "frc", frc_index, -1, "frc_encoded")
    return ft.with_rounded_features(df)
