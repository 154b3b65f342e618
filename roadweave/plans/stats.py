"""Mean statistics per city, district and road, and the lookup that falls back through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.geo import with_district
from roadweave.functions.numeric import rounded
from roadweave.operators.sizing import broadcast_if_small

MEASURES = {
    "avg_speed": "current_speed",
    "avg_free_flow_speed": "free_flow_speed",
    "avg_congestion_ratio": "congestion_ratio",
    "avg_delay_seconds": "delay_seconds",
}


def location_statistics(history: DataFrame, first_by: list[str]) -> DataFrame:
    """Long table ``(level, key, means..., sample_count, first road attributes)``.

    The readings are aggregated once, per road and district; the three levels are grouping
    sets over that small result.  A NULL road or district has no row of its own but still
    counts for the levels above.  ``first_by`` orders the readings of a road; its earliest
    reading gives the road's district, coordinates and class.
    """
    if "district" not in history.columns:
        history = with_district(history)
    sums = [x for name, c in MEASURES.items()
            for x in (F.sum(c).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n"))]
    first = F.struct(
        F.struct(*first_by).alias("at"), "district",
        F.col("requested_lat").alias("lat"), F.col("requested_lon").alias("lon"), "frc")
    fine = history.groupBy(F.col("location_name").alias("location"), "district").agg(
        *sums, F.count(F.lit(1)).alias("n"), F.min_by(first, first["at"]).alias("first"))
    rolled = fine.groupingSets([[], ["district"], ["location"]], "district", "location").agg(
        F.grouping_id().alias("set"),
        *[(F.sum(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0))).alias(m) for m in MEASURES],
        F.sum("n").alias("sample_count"),
        F.min_by("first", F.col("first.at")).alias("first"),
    )
    # grouping_id: a set bit marks a rolled-up column, (district, location) from left to right
    level = F.when(F.col("set") == 3, "city").when(F.col("set") == 1, "district").otherwise("location")
    on_road = F.col("level") == "location"
    return (
        rolled.withColumn("level", level)
        .withColumn("key", F.coalesce(F.when(on_road, F.col("location")).otherwise(F.col("district")),
                                      F.when(F.col("level") == "city", F.lit(""))))
        .filter(F.col("key").isNotNull())
        .select("level", "key", *MEASURES, "sample_count",
                *[F.when(on_road, F.col(f"first.{c}")).alias(c) for c in ("district", "lat", "lon", "frc")])
    )


def city_row(stats: DataFrame) -> DataFrame:
    """The city-wide means, with the fixed fallback where the document has none."""
    city = stats.filter(F.col("level") == "city")
    return city.agg(F.struct(*[
        F.coalesce(F.max(m), F.lit(fv.FALLBACK_STATS[m])).alias(m) for m in MEASURES]).alias("city"))


def with_location_stats(readings: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``stats`` = struct of the four means, ``district`` and ``source``.

    Road row, else the row of the district at the coordinates, else the city.  Without
    coordinates there is no district and the answer is city-wide.  A column ``_place`` with
    the district of the coordinates is used up if the readings have one.
    """
    means = F.struct(*MEASURES)
    roads = broadcast_if_small(stats.filter(F.col("level") == "location").select(
        F.col("key").alias("location_name"), means.alias("_road"),
        F.coalesce("district", F.lit("Unknown")).alias("_road_district")))
    districts = broadcast_if_small(stats.filter(F.col("level") == "district").select(
        F.col("key").alias("_place"), means.alias("_area")))
    placed = readings if "_place" in readings.columns else with_district(readings, output="_place")
    city = city_row(stats).scalar()

    def answer(numbers, place, source):
        return F.struct(*[numbers[m].alias(m) for m in MEASURES], place.alias("district"), F.lit(source).alias("source"))

    found = (
        F.when(F.col("_road").isNotNull(), answer(F.col("_road"), F.col("_road_district"), "location"))
        .when(F.col("_area").isNotNull(), answer(F.col("_area"), F.col("_place"), "district"))
        .otherwise(answer(F.col("_city"), F.coalesce("_place", F.lit("Unknown")), "city_wide"))
    )
    return (
        placed.join(roads, "location_name", "left")
        .join(districts, "_place", "left")
        .withColumn("_city", city)
        .withColumn("stats", found)
        .drop("_place", "_road", "_road_district", "_area", "_city")
    )


def with_district_target(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``district_target_encoded``: mean ratio of the row's district, else of the city."""
    targets = broadcast_if_small(stats.filter(F.col("level") == "district").select(
        F.col("key").alias("district"), F.col("avg_congestion_ratio").alias("_target")))
    return (
        df.join(targets, "district", "left")
        .withColumn("district_target_encoded",
                    F.coalesce("_target", city_row(stats).scalar()["avg_congestion_ratio"]))
        .drop("_target")
    )


def store_summary(stats: DataFrame) -> DataFrame:
    """How many roads and districts are known, and the city's mean speed."""
    return stats.agg(
        F.count_if(F.col("level") == "location").alias("n_locations"),
        F.count_if(F.col("level") == "district").alias("n_districts"),
        rounded(F.coalesce(F.max(F.when(F.col("level") == "city", F.col("avg_speed"))),
                           F.lit(fv.FALLBACK_STATS["avg_speed"])), 4).alias("city_avg_speed"),
    )
