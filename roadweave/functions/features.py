"""Model features of one reading, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions import lookups
from roadweave.functions.numeric import rounded


def or_default(value: Column, default) -> Column:
    """Replace NULL *and zero*, as the feature definition asks for."""
    return F.coalesce(F.nullif(value, F.lit(default * 0)), F.lit(default))


def with_base_features(df: DataFrame) -> DataFrame:
    """Ratio, speed drop and delay; missing numbers count as 0.  Unrounded."""
    zero = F.lit(0.0)
    speed, free_flow = F.coalesce("current_speed", zero), F.coalesce("free_flow_speed", zero)
    ratio = lookups.congestion_ratio(speed, free_flow)
    delay = F.coalesce("current_travel_time", F.lit(0)) - F.coalesce("free_flow_travel_time", F.lit(0))
    return df.withColumns({
        "current_speed": speed,
        "free_flow_speed": free_flow,
        "congestion_ratio": ratio,
        "speed_drop_pct": (1 - ratio) * 100,
        "delay_seconds": F.greatest(F.lit(0), delay),
    })


def with_time_features(df: DataFrame, as_of: Column, ts: str = "request_time") -> DataFrame:
    """Calendar features, Monday = 0; an unreadable time counts as ``as_of``."""
    at = F.coalesce(lookups.instant(df, ts), as_of)
    hour, day = F.hour(at), F.weekday(at)
    return df.withColumns({
        "event_time": at,
        "hour": hour,
        "day_of_week": day,
        "is_weekend": day.isin(4, 5).cast("int"),
        "month": F.month(at),
        "is_rush_hour": lookups.is_rush_hour(hour).cast("int"),
        "time_period": lookups.time_period_code(hour),
    })


def with_weather_features(df: DataFrame) -> DataFrame:
    defaults = fv.WEATHER_DEFAULTS
    return df.withColumns({
        "temperature": or_default(F.col("weather_temp"), defaults["weather_temp"]),
        "humidity": or_default(F.col("weather_humid"), defaults["weather_humid"]),
        "wind_speed": or_default(F.col("weather_wind"), defaults["weather_wind"]),
        "rain_mm": or_default(F.col("weather_rain"), defaults["weather_rain"]),
        "weather_main": F.coalesce(F.nullif("weather_main", F.lit("")), F.lit("Clear")),
        "is_raining": (F.coalesce("weather_rain", F.lit(0.0)) > 0).cast("int"),
    })


def with_rounded_features(df: DataFrame) -> DataFrame:
    digits = {
        "congestion_ratio": 4, "speed_drop_pct": 2, "speed_deviation": 2,
        "loc_avg_speed": 2, "loc_avg_congestion": 4, "district_target_encoded": 4,
    }
    return df.withColumns({c: rounded(F.col(c), n) for c, n in digits.items() if c in df.columns})


def with_exploration_columns(df: DataFrame) -> DataFrame:
    """Columns of the exploration report: the delay may be negative, the ratio may be NULL."""
    free_flow, speed = F.col("free_flow_speed"), F.col("current_speed")
    hour = F.hour("request_time")
    df = df.withColumns({
        "hour": hour,
        "minute": F.minute("request_time"),
        "day_of_week": F.date_format("request_time", "EEEE"),
        "date": F.to_date("request_time"),
        "congestion_ratio": rounded(F.try_divide(speed, free_flow), 4),
        "speed_drop_pct": rounded(F.try_divide((free_flow - speed) * 100, free_flow), 2),
        "delay_seconds": F.col("current_travel_time") - F.col("free_flow_travel_time"),
        "is_rush_hour": F.when(lookups.is_rush_hour(hour), F.lit("Rush hour")).otherwise(F.lit("Off-peak")),
        "road_type": lookups.road_type(F.col("frc")),
    })
    return df.withColumn("congestion_level", lookups.eda_level(F.col("congestion_ratio")))
