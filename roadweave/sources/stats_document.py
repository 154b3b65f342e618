"""The statistics document (city, districts, locations) as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from roadweave import fixed_values as fv
from roadweave import schemas


def write_stats(stats: DataFrame, path: str) -> None:
    """JSON lines sorted by level and key."""
    stats.orderBy("level", "key").write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The stored document, or the fallback constants as a city row when there is none."""
    try:
        return spark.read.schema(schemas.LOCATION_STATS).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return fallback_stats(spark)


def fallback_stats(spark: SparkSession) -> DataFrame:
    known = {"level": "city", "key": "", **fv.FALLBACK_STATS}
    names = [part.split()[0] for part in schemas.LOCATION_STATS.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(known.get(n) for n in names)], schemas.LOCATION_STATS)


def read_nested_stats(spark: SparkSession, path: str) -> DataFrame:
    """The same statistics from one nested JSON object per file."""
    numbers = ("avg_speed double, avg_free_flow_speed double, avg_congestion_ratio double, "
               "avg_delay_seconds double, sample_count bigint")
    struct = "struct<" + numbers.replace(" double", ": double").replace(" bigint", ": bigint")
    schema = (f"city_wide {struct}>, districts map<string, {struct}>>, "
              f"locations map<string, {struct}, district: string, lat: double, lon: double, frc: string>>")
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    measures = ["avg_speed", "avg_free_flow_speed", "avg_congestion_ratio", "avg_delay_seconds", "sample_count"]
    places = ["district", "lat", "lon", "frc"]
    unknown = [F.lit(None).cast(t).alias(n) for n, t in zip(places, ["string", "double", "double", "string"])]
    city = document.select(F.lit("city").alias("level"), F.lit("").alias("key"),
                           *[F.col(f"city_wide.{m}") for m in measures], *unknown)
    districts = document.select(F.explode("districts").alias("key", "v")).select(
        F.lit("district").alias("level"), "key", *[F.col(f"v.{m}") for m in measures], *unknown)
    locations = document.select(F.explode("locations").alias("key", "v")).select(
        F.lit("location").alias("level"), "key", *[F.col(f"v.{m}") for m in measures + places])
    return city.unionByName(districts).unionByName(locations)
