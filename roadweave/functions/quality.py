"""Data quality checks of one reading, as a typed array of issues plus a score.

Every check is a condition column; the same condition feeds the issue list and the
deduction sum, so one projection scores a reading without Python and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import rounded_text

ISSUE_TYPE = "array<struct<check:string,severity:string,message:string>>"


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    failed: Column
    message: Column

    def issue(self) -> Column:
        return F.when(
            self.failed,
            F.struct(
                F.lit(self.name).alias("check"),
                F.lit(self.severity).alias("severity"),
                self.message.alias("message"),
            ),
        )

    def deduction(self) -> Column:
        return F.when(self.failed, F.lit(fv.DEDUCTIONS[self.severity])).otherwise(F.lit(0))


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def identity_checks() -> list[Check]:
    """Checks whose failure makes the reading unusable and skips all the others."""
    no_place = F.col("requested_lat").isNull() | F.col("requested_lon").isNull()
    return [
        Check("required_fields", "fatal", F.coalesce(F.col("location_name"), F.lit("")) == "",
              F.lit("missing location_name")),
        Check("required_fields", "fatal", no_place, F.lit("missing lat/lon coordinates")),
    ]


def value_checks(as_of: Column) -> list[Check]:
    speed, free_flow = F.col("current_speed"), F.col("free_flow_speed")
    lat, lon = F.col("requested_lat"), F.col("requested_lon")
    temp, humidity, rain = F.col("weather_temp"), F.col("weather_humid"), F.col("weather_rain")
    sent = F.col("request_time").cast("string")
    sent_at = F.try_to_timestamp(sent)
    age = (F.unix_micros(as_of) - F.unix_micros(sent_at)) / F.lit(60e6)
    share = speed / F.nullif(free_flow, F.lit(0.0))
    flowing = F.col("road_closure") & (speed != 0) & (free_flow > 0) & (share >= 0.80)
    (south, north), (west, east) = fv.QUALITY_LAT, fv.QUALITY_LON
    return [
        Check("speed_sanity", "fatal", speed.isNull(), F.lit("current_speed is null")),
        Check("speed_sanity", "critical", speed < 0,
              F.concat(F.lit("negative speed: "), speed.cast("string"), F.lit(" km/h"))),
        Check("speed_sanity", "critical", speed > 200,
              F.concat(F.lit("unrealistic speed: "), speed.cast("string"), F.lit(" km/h (max expected: 200)"))),
        Check("free_flow_sanity", "critical", F.coalesce(free_flow <= 0, F.lit(True)),
              F.concat(F.lit("invalid free_flow_speed: "), _shown(free_flow))),
        Check("closure_consistency", "warning", flowing,
              F.concat(F.lit("closure flag set but traffic flowing (speed="), speed.cast("string"),
                       F.lit(" = "), rounded_text(share * 100, 0), F.lit("% of free-flow "),
                       free_flow.cast("string"), F.lit(")"))),
        Check("coordinates", "critical", ~lat.between(south, north),
              F.concat(F.lit("latitude "), lat.cast("string"),
                       F.lit(f" outside Cairo bounds ({south}-{north})"))),
        Check("coordinates", "critical", ~lon.between(west, east),
              F.concat(F.lit("longitude "), lon.cast("string"),
                       F.lit(f" outside Cairo bounds ({west}-{east})"))),
        Check("freshness", "warning", age > fv.STALE_MINUTES,
              F.concat(F.lit("reading is "), rounded_text(age, 0),
                       F.lit(f" min old (threshold: {fv.STALE_MINUTES} min)"))),
        Check("freshness", "info", (sent != "") & sent_at.isNull(),
              F.concat(F.lit("could not parse timestamp: "), sent)),
        Check("weather_sanity", "warning", (temp < -10) | (temp > 60),
              F.concat(F.lit("unrealistic temperature: "), temp.cast("string"), F.lit("°C"))),
        Check("weather_sanity", "info", (humidity < 0) | (humidity > 100),
              F.concat(F.lit("humidity out of range: "), humidity.cast("string"), F.lit("%"))),
        Check("weather_sanity", "info", rain < 0,
              F.concat(F.lit("negative rain value: "), rain.cast("string"), F.lit(" mm"))),
    ]


def with_quality(readings: DataFrame, as_of: Column) -> DataFrame:
    """Add ``issues``, ``issues_count``, ``quality_score``, ``fatal`` and ``passed``."""
    first, later = identity_checks(), value_checks(as_of)

    def any_of(conditions):
        result = F.lit(False)
        for condition in conditions:
            result = result | F.coalesce(condition, F.lit(False))
        return result

    def total(checks):
        return sum((c.deduction() for c in checks[1:]), checks[0].deduction())

    def found(checks):
        return F.array_compact(F.array(*[c.issue() for c in checks]))

    unusable = any_of(c.failed for c in first)
    fatal = unusable | any_of(c.failed for c in later if c.severity == "fatal")
    lost = total(first) + F.when(unusable, F.lit(0)).otherwise(total(later))
    return (
        readings
        .withColumn("issues", F.when(unusable, found(first)).otherwise(found(later)))
        .withColumn("issues_count", F.size("issues"))
        .withColumn("quality_score", F.greatest(F.lit(0), F.lit(100) - lost))
        .withColumn("fatal", fatal)
        .withColumn("passed", ~F.col("fatal") & (F.col("quality_score") >= fv.PASS_SCORE))
    )


def route(score: Column, passed: Column, issues_count: Column) -> Column:
    """Where a checked reading goes: dropped, kept with a flag, or kept."""
    return (
        F.when(~passed, F.lit("fail"))
        .when((score < fv.WARN_SCORE) & (issues_count > 0), F.lit("warn"))
        .otherwise(F.lit("pass"))
    )
