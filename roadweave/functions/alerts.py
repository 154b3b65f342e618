"""Alert rules of one scored reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import rounded_text


def _alert(kind: str, severity: Column | str, message: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(kind).alias("kind"),
        severity.alias("severity"),
        F.concat(severity, F.lit(f":{kind}")).alias("alert_type"),
        message.alias("message"),
    )


def _speeds() -> Column:
    return F.concat(F.lit("Speed "), F.col("current_speed").cast("string"), F.lit(" km/h (free-flow "),
                    F.col("free_flow_speed").cast("string"), F.lit(" km/h)"))


def anomaly_alert() -> Column:
    score = F.col("anomaly_score")
    severity = F.when(score < -0.05, F.lit("critical")).when(score < 0, F.lit("warning")).otherwise(F.lit("info"))
    message = F.concat(
        F.lit("Anomaly detected: "),
        F.coalesce(F.nullif("anomaly_reason", F.lit("")), F.lit("unusual pattern")),
        F.lit(". Speed "), F.col("current_speed").cast("string"), F.lit(" km/h vs "),
        F.col("free_flow_speed").cast("string"), F.lit(" km/h free-flow. Score: "), score.cast("string"),
    )
    return F.when(F.col("is_anomaly"), _alert("ANOMALY", severity, message))


def congestion_alert() -> Column:
    level, rush = F.col("predicted_congestion"), F.col("is_rush_hour") == 1
    at_hour = F.concat(F.lit(" at hour "), F.col("hour").cast("string"))

    def sentence(text, tail):
        return F.concat(F.lit(text), _speeds(), tail)

    return (
        F.when((level == "Severe") & ~rush,
               _alert("SEVERE_CONGESTION", "critical", sentence("Severe congestion outside rush hour. ", at_hour)))
        .when(level == "Severe",
              _alert("SEVERE_CONGESTION", "warning", sentence("Severe congestion during rush hour. ", F.lit(""))))
        .when((level == "Heavy") & ~rush,
              _alert("HEAVY_CONGESTION", "info", sentence("Heavy congestion outside rush hour. ", at_hour)))
    )


def closure_alert(provider: str = "TomTom") -> Column:
    """Needs ``is_new_closure``; ``provider`` names the data source quoted in the text."""
    message = F.concat(F.lit("Road closure detected. "), _speeds(),
                       F.lit(f". {provider} reports road_closure=true"))
    return F.when(F.col("is_new_closure"), _alert("ROAD_CLOSURE", "warning", message))


def city_alert() -> Column:
    """Alert of one round; needs ``pct`` (unrounded) and a count column per level."""
    text = F.concat(rounded_text(F.col("pct"), 0), F.lit("% of roads showing congestion or closure"))
    counts = F.concat(
        *[x for level in fv.LEVELS[1:] for x in (F.lit(f" {level}:"), F.col(level).cast("string"))])
    return (
        F.when(F.col("pct") > 60, _alert("CITY_WIDE", "critical", F.concat(text, F.lit("."), counts)))
        .when(F.col("pct") > 40, _alert("CITY_WIDE", "warning", text))
    )
