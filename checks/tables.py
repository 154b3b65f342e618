"""Stand-in tables derived from the whole ``events`` table by plain projections.

``events`` has no roads, speeds or weather; these views give every event a road, speeds,
weather and coordinates from its own columns, so the queries grow with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.lookups import congestion_level, congestion_ratio, incident_type, target_time
from roadweave.functions.quality import with_quality
from roadweave.functions.texts import anomaly_reason
from roadweave.functions.numeric import rounded
from roadweave.operators.lags import with_lags
from roadweave.plans.warehouse import fact_rows
from roadweave.session import checkpoint_dir
from roadweave.sources.dimensions import seed_times, seed_weather
from roadweave.streaming.windows import road_windows


def as_of() -> Column:
    """The moment the queries look back from: just after the last event."""
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def readings(spark: SparkSession, path: str) -> DataFrame:
    return as_readings(spark.read.parquet(f"{path}/events.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt to as many tasks as there are cores, where its files give fewer (a task takes whole row groups)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *df.columns[:3])


def spread_readings(spark: SparkSession, path: str) -> DataFrame:
    return as_readings(spread(spark.read.parquet(f"{path}/events.parquet")))


STREAM_BATCHES = 4
LEAST_FILES, LEAST_ROWS, FILE_ROWS = 4, 25_000, 2_000_000


def stream_files(rows: int, cores: int) -> int:
    """Files of a micro-batch of ``rows``: as many for each core, none of few rows, as a file is read by one task."""
    return max(LEAST_FILES, min(rows // LEAST_ROWS, cores * -(-rows // (cores * FILE_ROWS))))


def stream_of(parts: list[DataFrame], folder: str, rows: int) -> DataFrame:
    """A stream that takes each part as one micro-batch.

    ``rows`` is the size of the largest part.  Every part becomes the same number of files, written and read side by side,
    and a micro-batch takes that many; files are taken in the order they were written.
    """
    files = stream_files(rows, parts[0].sparkSession.sparkContext.defaultParallelism)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    spark = parts[0].sparkSession
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def reading_stream(spark: SparkSession, path: str, batches: int = STREAM_BATCHES) -> DataFrame:
    """The same readings as a stream: all events in micro-batches that follow each other by event_id.

    The cuts lie anywhere in a round.
    """
    events = spark.read.parquet(f"{path}/events.parquet")
    first, last, rows = events.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    size = (last - first) // batches + 1
    parts = [events.filter(F.floor((F.col("event_id") - first) / size) == part) for part in range(batches)]
    return as_readings(stream_of(parts, f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}/events", rows // batches))


def as_readings(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS reading_id",
        "CAST(ts AS timestamp) AS request_time",
        "concat('Road ', lpad(CAST(user_id % 25 AS string), 2, '0')) AS location_name",
        "2.99e1 + (user_id % 25) * 1.2e-2 AS requested_lat",
        "3.11e1 + ((user_id * 7) % 25) * 1.3e-2 AS requested_lon",
        "concat('FRC', CAST(user_id % 6 AS string)) AS frc",
        "value AS current_speed",
        "CAST(40 + 3 * (user_id % 25) AS double) AS free_flow_speed",
        "CAST(50 + (event_id * 7) % 400 AS int) AS current_travel_time",
        "CAST(60 + event_id % 120 AS int) AS free_flow_travel_time",
        "CAST(event_id % 101 AS double) / 1e2 AS confidence",
        "event_id % 97 = 0 AS road_closure",
        "CAST(event_id % 450 AS double) / 1e1 AS weather_temp",
        "CAST(event_id % 101 AS int) AS weather_humid",
        "CAST(event_id % 23 AS double) / 2e0 AS weather_wind",
        "CASE WHEN event_id % 10 = 0 THEN CAST(event_id % 70 AS double) / 1e1 ELSE 0e0 END AS weather_rain",
        "CASE event_type WHEN 'click' THEN 'Clear' WHEN 'view' THEN 'Clouds' WHEN 'purchase' THEN 'Rain' "
        "WHEN 'error' THEN 'Dust' ELSE 'Fog' END AS weather_main",
        "event_type",
        "user_id",
    )


def plain_readings(spark: SparkSession, path: str) -> DataFrame:
    return readings(spark, path).drop("event_type", "user_id")


def with_ratio(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("congestion_ratio", congestion_ratio(F.col("current_speed"), F.col("free_flow_speed")))
        .withColumn("congestion_level", congestion_level(F.col("congestion_ratio"), F.col("road_closure")))
    )


def messages(spark: SparkSession, path: str) -> DataFrame:
    return as_messages(plain_readings(spark, path))


def spread_messages(spark: SparkSession, path: str) -> DataFrame:
    return as_messages(spread_readings(spark, path).drop("event_type", "user_id"))


def message_stream(spark: SparkSession, path: str, batches: int = STREAM_BATCHES) -> DataFrame:
    return as_messages(reading_stream(spark, path, batches).drop("event_type", "user_id"))


def as_messages(df: DataFrame) -> DataFrame:
    """Readings as they arrive: text times, and every kind of defect the checks look for."""
    def defect(every, value, column):
        return F.when(F.col("reading_id") % every == 0, value).otherwise(F.col(column))

    sent = F.date_format("request_time", "yyyy-MM-dd HH:mm:ss")
    return df.withColumns({
        "arrived_at": F.col("request_time") + F.make_interval(mins=(F.col("reading_id") % 20).cast("int")),
        "request_time": F.when(F.col("reading_id") % 179 == 0, F.lit("not-a-time"))
        .when(F.col("reading_id") % 173 == 0, F.lit("")).otherwise(sent),
        "location_name": F.when(F.col("reading_id") % 211 == 0, F.lit(None).cast("string"))
        .when(F.col("reading_id") % 223 == 0, F.lit("")).otherwise(F.col("location_name")),
        "requested_lat": F.when(F.col("reading_id") % 199 == 0, F.lit(None).cast("double"))
        .when(F.col("reading_id") % 151 == 0, F.col("requested_lat") + 1).otherwise(F.col("requested_lat")),
        "current_speed": F.when(F.col("reading_id") % 193 == 0, F.lit(None).cast("double"))
        .when(F.col("reading_id") % 191 == 0, -F.col("current_speed")).otherwise(F.col("current_speed")),
        "free_flow_speed": F.when(F.col("reading_id") % 181 == 0, F.lit(0.0))
        .when(F.col("reading_id") % 183 == 0, F.lit(None).cast("double")).otherwise(F.col("free_flow_speed")),
        "weather_temp": defect(167, F.col("weather_temp") + 100, "weather_temp"),
        "weather_humid": defect(163, F.lit(-5), "weather_humid"),
        "weather_rain": defect(157, F.lit(-1.5), "weather_rain"),
    })


def quality(spark: SparkSession, path: str) -> DataFrame:
    checked = with_quality(messages(spark, path), F.col("arrived_at"))
    return checked.withColumn("event_id", F.col("reading_id")).withColumn("checked_at", F.col("arrived_at"))


def dim_location(spark: SparkSession) -> DataFrame:
    """25 rows by construction."""
    return spark.range(25, numPartitions=1).selectExpr(
        "CAST(id + 1 AS int) AS location_key",
        "concat('Road ', lpad(CAST(id AS string), 2, '0')) AS location_name",
        "2.99e1 + id * 1.2e-2 AS lat", "3.11e1 + ((id * 7) % 25) * 1.3e-2 AS lon",
        "concat('District ', CAST(id % 5 AS string)) AS district",
        "CASE id % 4 WHEN 0 THEN 'Highway' WHEN 1 THEN 'Main Road' WHEN 2 THEN 'Bridge' ELSE 'Corniche' END AS road_class",
    )


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    return {"dim_location": dim_location(spark), "dim_time": seed_times(spark), "dim_weather": seed_weather(spark)}


def fact(spark: SparkSession, path: str) -> DataFrame:
    return fact_rows(plain_readings(spark, path), dimensions(spark))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """The class of the road's previous reading predicts the current one."""
    df = with_ratio(readings(spark, path)).select(
        "reading_id", "request_time", "location_name", "confidence", "congestion_level", "user_id")
    before = with_lags(df, ["location_name"], "request_time", "reading_id", {"_before": ("congestion_level", 1)})
    return before.select(
        F.col("reading_id").alias("prediction_id"), F.col("request_time").alias("predicted_at"), "location_name",
        F.coalesce("_before", F.lit("Free Flow")).alias("predicted_congestion"),
        F.col("congestion_level").alias("actual_congestion"), "confidence",
        F.concat(F.lit("reason "), F.col("user_id").cast("string")).alias("top_reason_1"),
        F.lit("").alias("top_reason_2"), F.lit("").alias("top_reason_3"))


def scored(spark: SparkSession, path: str) -> DataFrame:
    return as_scored(readings(spark, path))


def scored_stream(spark: SparkSession, path: str) -> DataFrame:
    return as_scored(reading_stream(spark, path))


def as_scored(df: DataFrame) -> DataFrame:
    """Readings with a model's verdict: errors are anomalies, the score comes from the id."""
    df = with_ratio(df)
    drop = (1 - F.col("congestion_ratio")) * 100
    hour = F.hour("request_time")
    return df.withColumns({
        "predicted_congestion": F.col("congestion_level"),
        "is_anomaly": F.col("event_type") == "error",
        "anomaly_score": rounded((F.col("reading_id") * 37 % 400).cast("double") / 1e3 - 0.3, 4),
        "hour": hour,
        "is_rush_hour": (hour.between(7, 9) | hour.between(16, 19)).cast("int"),
        "speed_drop_pct": drop,
        "speed_deviation": F.col("current_speed") - 50,
    }).withColumn("anomaly_reason", F.when(F.col("is_anomaly"), anomaly_reason(
        F.col("road_closure"), F.col("speed_drop_pct"), F.col("speed_deviation"), F.col("weather_rain"),
        F.col("anomaly_score"))))


def anomalies(spark: SparkSession, path: str) -> DataFrame:
    return scored(spark, path).filter("is_anomaly").select(
        F.col("reading_id").alias("anomaly_id"), F.col("request_time").alias("detected_at"), "location_name",
        "anomaly_score", "current_speed", "free_flow_speed", rounded(F.col("congestion_ratio"), 4).alias("congestion_ratio"),
        F.col("anomaly_reason").alias("reason"))


def alerts(spark: SparkSession, path: str) -> DataFrame:
    df = readings(spark, path).filter(F.col("event_type").isin("error", "purchase"))
    return df.select(
        F.col("reading_id").alias("alert_id"), F.col("request_time").alias("triggered_at"), "location_name",
        F.when(F.col("event_type") == "error", "critical:ANOMALY").otherwise("warning:ROAD_CLOSURE").alias("alert_type"),
        F.concat(F.lit("Reading "), F.col("reading_id").cast("string"), F.lit(" on "), F.col("location_name"),
                 F.lit(" was measured at "), F.col("current_speed").cast("string"),
                 F.lit(" km/h and has been reported to the control room")).alias("message"),
        F.lit(True).alias("delivered"))


def incidents(spark: SparkSession, path: str) -> DataFrame:
    df = readings(spark, path).filter(F.col("event_type") == "error")
    shift = F.col("reading_id") % 4
    return df.select(
        F.col("reading_id").alias("row_id"), F.col("request_time").alias("fetched_at"),
        F.col("user_id").alias("incident_id"), (F.col("reading_id") % 15).cast("int").alias("icon_category"),
        incident_type(F.col("reading_id") % 15).alias("incident_type"),
        (F.col("reading_id") % 600 - 30).cast("double").alias("delay_seconds"),
        (F.col("requested_lat") + shift * 6e-4).alias("lat"), (F.col("requested_lon") - shift * 4e-4).alias("lon"))


def weather(spark: SparkSession, path: str) -> DataFrame:
    """One city series: the weather columns of the ``view`` events."""
    return as_weather(readings(spark, path))


def as_weather(df: DataFrame) -> DataFrame:
    return df.filter(F.col("event_type") == "view").select(
        F.col("reading_id").alias("weather_id"), F.col("request_time").alias("recorded_at"),
        F.col("weather_temp").alias("temperature"), (F.col("weather_temp") - 1).alias("feels_like"),
        F.col("weather_humid").alias("humidity"), "weather_main",
        F.lower("weather_main").alias("weather_desc"), F.col("weather_wind").alias("wind_speed"),
        F.col("weather_rain").alias("rain_mm"))


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Naive forecasts: the speed 1, 3 and 6 rows back stands for the next 20, 30 and 60 minutes."""
    df = with_ratio(readings(spark, path)).select(
        "reading_id", "request_time", "location_name", "current_speed", "congestion_level", "confidence")
    lagged = with_lags(df, ["location_name"], "request_time", "reading_id", {
        "20min": ("current_speed", 1), "30min": ("current_speed", 3), "60min": ("current_speed", 6)})
    return (
        lagged.unpivot(["reading_id", "request_time", "location_name", "congestion_level", "confidence"],
                       ["20min", "30min", "60min"], "horizon", "predicted_speed")
        .filter(F.col("predicted_speed").isNotNull())
        .select(F.col("reading_id").alias("forecast_id"), F.col("request_time").alias("forecast_made_at"),
                "location_name", "horizon", target_time(F.col("request_time"), F.col("horizon")).alias("target_time"),
                "predicted_speed", F.col("congestion_level").alias("predicted_class"), "confidence")
    )


def aggregates(spark: SparkSession, path: str) -> DataFrame:
    return road_windows(plain_readings(spark, path), ts="request_time")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """One summary per day; every third day's failed, the others have NULL or empty errors."""
    df = readings(spark, path)
    day = F.dayofmonth(F.to_date("request_time"))
    return (
        df.groupBy(F.to_date("request_time").alias("day"))
        .agg(F.max("request_time").alias("generated_at"), F.count(F.lit(1)).alias("tokens_in"),
             F.max("current_speed").alias("top"))
        .withColumn("n", F.dayofmonth("day"))
        .select("generated_at",
                F.concat(F.lit("Top speed "), F.col("top").cast("string"), F.lit(" km/h")).alias("summary_text"),
                F.lit("{}").alias("snapshot_data"), "tokens_in", (F.col("n") * 3).alias("tokens_out"),
                (F.col("n") * 100).alias("elapsed_ms"), F.lit(False).alias("cached"),
                F.when(F.col("n") % 3 == 0, "quota exceeded").when(F.col("n") % 3 == 1, "").alias("error"))
    )
