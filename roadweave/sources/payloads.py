"""Raw API payloads (JSON text) to flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave import schemas
from roadweave.functions.lookups import delay_magnitude, incident_type


def parse_flow(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Flow segment -> reading columns.  Keeps the other columns (request time, coordinates)."""
    flow = F.from_json(F.col(payload), schemas.FLOW_PAYLOAD)["flowSegmentData"]
    return raw.withColumn("_flow", flow).select(
        *[c for c in raw.columns if c != payload],
        F.col("_flow.frc").alias("frc"),
        F.col("_flow.currentSpeed").alias("current_speed"),
        F.col("_flow.freeFlowSpeed").alias("free_flow_speed"),
        F.col("_flow.currentTravelTime").alias("current_travel_time"),
        F.col("_flow.freeFlowTravelTime").alias("free_flow_travel_time"),
        F.col("_flow.confidence").alias("confidence"),
        F.coalesce("_flow.roadClosure", F.lit(False)).alias("road_closure"),
        F.col(payload).alias("raw_payload"),
    )


def parse_weather(raw: DataFrame, payload: str = "payload") -> DataFrame:
    weather = F.from_json(F.col(payload), schemas.WEATHER_PAYLOAD)
    return raw.withColumn("_w", weather).select(
        *[c for c in raw.columns if c != payload],
        F.col("_w.main.temp").alias("temperature"),
        F.col("_w.main.feels_like").alias("feels_like"),
        F.col("_w.main.humidity").alias("humidity"),
        F.get("_w.weather", F.lit(0))["main"].alias("weather_main"),
        F.get("_w.weather", F.lit(0))["description"].alias("weather_desc"),
        F.col("_w.wind.speed").alias("wind_speed"),
        F.coalesce(F.col("_w.rain.`1h`"), F.lit(0.0)).alias("rain_mm"),
        F.col(payload).alias("raw_payload"),
    )


def explode_incidents(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per incident.  The place is the middle vertex of a line, or the first point."""
    features = F.from_json(F.col(payload), schemas.INCIDENT_PAYLOAD)["incidents"]
    kept = [c for c in raw.columns if c != payload]
    line = F.from_json("_text", "array<array<double>>")
    pair = F.from_json("_text", "array<double>")
    middle = F.get(F.col("_line"), F.floor(F.size("_line") / 2).cast("int"))
    on_line = (F.col("_f.geometry.type") == "LineString") & (F.size("_line") > 1)
    described = F.filter(F.transform("_f.properties.events", lambda e: e["description"]),
                         lambda d: F.coalesce(d, F.lit("")) != "")
    code = F.coalesce("_f.properties.iconCategory", F.lit(0))
    return (
        raw.select(*kept, F.explode(features).alias("_f"))
        .withColumn("_text", F.col("_f.geometry.coordinates"))
        .withColumns({"_line": F.when(F.col("_text").startswith("[["), line),
                      "_pair": F.when(~F.col("_text").startswith("[["), pair)})
        .withColumn("_point", F.coalesce(F.when(on_line, middle), F.get("_line", F.lit(0)), F.col("_pair")))
        .select(
            *kept,
            F.coalesce("_f.properties.id", F.lit("")).alias("incident_id"),
            incident_type(code).alias("incident_type"),
            code.alias("icon_category"),
            delay_magnitude(F.coalesce("_f.properties.magnitudeOfDelay", F.lit(0))).alias("magnitude"),
            F.coalesce(F.nullif(F.concat_ws("; ", described), F.lit("")), F.lit("No description")).alias("description"),
            F.coalesce("_f.properties.from", F.lit("")).alias("road_from"),
            F.coalesce("_f.properties.to", F.lit("")).alias("road_to"),
            F.concat_ws(", ", F.col("_f.properties.roadNumbers")).alias("road_numbers"),
            F.coalesce("_f.properties.delay", F.lit(0.0)).alias("delay_seconds"),
            F.coalesce("_f.properties.length", F.lit(0.0)).alias("length_meters"),
            F.get("_point", F.lit(1)).alias("lat"),
            F.get("_point", F.lit(0)).alias("lon"),
            F.col("_f.properties.startTime").alias("start_time"),
            F.col("_f.properties.endTime").alias("end_time"),
            F.to_json("_f.geometry").alias("raw_geometry"),
        )
    )
