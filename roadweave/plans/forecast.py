"""Lag features, the 32-column forecast row, buffer backfill and forecast rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.lookups import congestion_ratio, is_forecast_rush_hour, target_time
from roadweave.functions.numeric import rounded
from roadweave.operators.lags import with_lags
from roadweave.operators.latest import recent_per_key, since
from roadweave.plans.features import encode

SERIES_KEY = ["location_name"]


def lag_features(readings: DataFrame, lag_rows: dict[str, int] | None = None, ts: str = "request_time",
                 tie: str = "reading_id", counted: DataFrame | None = None) -> DataFrame:
    """``speed_lag_*`` and ``ratio_lag_*``: rows back in the road's series, current row included."""
    lag_rows = lag_rows or fv.LAG_ROWS
    wanted = {}
    for label, back in lag_rows.items():
        wanted[f"speed_lag_{label}"] = ("current_speed", back)
        wanted[f"ratio_lag_{label}"] = ("congestion_ratio", back)
    return with_lags(readings.filter(F.col("location_name").isNotNull()), SERIES_KEY, ts, tie, wanted, counted=counted)


def with_trends(lagged: DataFrame) -> DataFrame:
    ratio_trend = F.col("congestion_ratio") - F.col("ratio_lag_30min")
    return lagged.withColumns({
        "speed_trend_30min": F.col("current_speed") - F.col("speed_lag_30min"),
        "ratio_trend_30min": ratio_trend,
        "congestion_buildup_1hr": F.col("ratio_lag_1hr") - F.col("ratio_lag_10min"),
        "buildup_acceleration": ratio_trend - (F.col("ratio_lag_1hr") - F.col("ratio_lag_30min")),
    })


def forecast_rows_from(features: DataFrame, frc_index: DataFrame, district_index: DataFrame,
                       extra: list[str] | None = None, readings: DataFrame | None = None) -> DataFrame:
    """The 32 forecast features of every reading whose road has all lags behind it.

    ``features`` is the congestion feature row plus ``reading_id`` and ``event_time``.
    ``readings`` (``location_name``, ``event_time`` of the same rows) saves computing the
    features a second time just to count rows.
    """
    rush = is_forecast_rush_hour(F.col("hour"), F.col("is_weekend") == 1).cast("int")
    lagged = with_trends(lag_features(features, ts="event_time", counted=readings)).filter(F.col("position") > fv.WARM_ROWS)
    lagged = lagged.withColumn("is_rush_hour", rush).drop("frc_encoded")
    coded = encode(encode(lagged, "frc", frc_index, 0, "frc_encoded"),
                   "district", district_index, 0, "district_encoded")
    return coded.select("reading_id", "location_name", "event_time", *(extra or []), *fv.FORECAST_FEATURES)


def forecast_table(predicted: DataFrame, made_at: str = "event_time") -> DataFrame:
    """One row per horizon from a map ``horizon -> struct(speed, class, confidence)``; empty ones skipped."""
    return (
        predicted.select("location_name", F.col(made_at).alias("forecast_made_at"),
                         F.explode("forecasts").alias("horizon", "forecast"))
        .filter(F.col("forecast").isNotNull())
        .select(
            "forecast_made_at", "location_name", "horizon",
            target_time(F.col("forecast_made_at"), F.col("horizon")).alias("target_time"),
            F.col("forecast.speed").alias("predicted_speed"),
            F.col("forecast.class").alias("predicted_class"),
            F.col("forecast.confidence").alias("confidence"))
    )


# buffer backfill ----------------------------------------------------------------------


def usable(readings: DataFrame) -> DataFrame:
    return readings.filter(
        F.col("current_speed").isNotNull() & F.col("free_flow_speed").isNotNull() & (F.col("free_flow_speed") > 0))


def active_roads(readings: DataFrame, as_of: Column, days: float = 7) -> DataFrame:
    recent = readings.filter(F.col("location_name").isNotNull() & since("request_time", as_of, days * 24))
    return recent.select("location_name").distinct().orderBy("location_name")


def recent_readings(readings: DataFrame, as_of: Column, hours: float = fv.BACKFILL_HOURS,
                    count: int = fv.BACKFILL_ROWS) -> DataFrame:
    """The newest usable readings of every road, oldest first within the road."""
    recent = usable(readings).filter(F.col("location_name").isNotNull() & since("request_time", as_of, hours))
    return recent_per_key(recent, SERIES_KEY, ["request_time", "reading_id"], count).orderBy(
        "location_name", F.desc("recency"))


def buffer_records(readings: DataFrame) -> DataFrame:
    speed, free_flow = F.coalesce("current_speed", F.lit(0.0)), F.coalesce("free_flow_speed", F.lit(0.0))
    return readings.select(
        "request_time", "location_name", speed.alias("current_speed"), free_flow.alias("free_flow_speed"),
        rounded(congestion_ratio(speed, free_flow), 4).alias("congestion_ratio"),
        F.coalesce("road_closure", F.lit(False)).alias("road_closure"), "requested_lat", "requested_lon")


def buffer_readiness(readings: DataFrame, as_of: Column, days: float = 7, hours: float = fv.BACKFILL_HOURS,
                     count: int = fv.BACKFILL_ROWS) -> DataFrame:
    """Rows available per active road and whether that is enough for a forecast.

    The count per road is capped by ``count`` arithmetically, so no ranking is needed; one scan.
    """
    good = (F.col("current_speed").isNotNull() & (F.col("free_flow_speed") > 0)
            & since("request_time", as_of, hours))
    loaded = F.least(F.count_if(F.coalesce(good, F.lit(False))), F.lit(count))
    return (
        readings.filter(F.col("location_name").isNotNull() & since("request_time", as_of, max(days * 24, hours)))
        .groupBy("location_name")
        .agg(loaded.alias("loaded"), F.max("request_time").alias("_newest"))
        .filter(since("_newest", as_of, days * 24))
        .select("location_name", "loaded",
                F.when(F.col("loaded") == 0, "empty").when(F.col("loaded") >= fv.WARM_ROWS, "warm")
                .otherwise("partial").alias("status"))
    )


def readiness_totals(readiness: DataFrame) -> DataFrame:
    return readiness.agg(
        F.coalesce(F.sum("loaded"), F.lit(0)).alias("total_pushed"), F.count(F.lit(1)).alias("roads"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("warm", "partial", "empty")])
