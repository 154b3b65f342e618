"""Sentences and labels shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import rounded_text


def joined(parts: list[Column], separator: str = "; ") -> Column:
    """Join the parts that are not NULL."""
    return F.concat_ws(separator, F.array(*parts))


def anomaly_reason(closed: Column, drop_pct: Column, deviation: Column, rain: Column, score: Column) -> Column:
    text = joined([
        F.when(closed, F.lit("road closure detected")),
        F.when(drop_pct > 30, F.concat(F.lit("speed "), rounded_text(drop_pct, 0), F.lit("% below free-flow"))),
        F.when(deviation < -10,
               F.concat(F.lit("speed "), rounded_text(F.abs(deviation), 1), F.lit("km/h below road average"))),
        F.when(rain > 5, F.concat(F.lit("heavy rain ("), rain.cast("string"), F.lit("mm)"))),
    ])
    fallback = F.concat(F.lit("strong anomaly signal (score="), rounded_text(score, 4), F.lit(")"))
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def prediction_reasons(closed: Column, rush: Column, hour: Column, deviation: Column, rain: Column) -> Column:
    """The reasons that apply, in fixed order, as an array."""
    return F.array_compact(F.array(
        F.when(closed, F.lit("road_closure flag is active")),
        F.when(rush, F.concat(F.lit("rush hour (hour="), hour.cast("string"), F.lit(")"))),
        F.when(deviation < -5,
               F.concat(F.lit("speed "), rounded_text(F.abs(deviation), 1), F.lit("km/h below average"))),
        F.when(deviation > 5,
               F.concat(F.lit("speed "), rounded_text(deviation, 1), F.lit("km/h above average"))),
        F.when(rain > 0, F.concat(F.lit("rain: "), rain.cast("string"), F.lit("mm"))),
    ))


def nth_or_blank(items: Column, position: int) -> Column:
    return F.coalesce(F.get(items, F.lit(position)), F.lit(""))


def weather_advisory(rain: Column, condition: Column) -> Column:
    """Struct ``(text, severity)``; rain decides before the condition does."""
    amount = rain.cast("string")

    def advice(text, severity):
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(text.alias("text"), F.lit(severity).alias("severity"))

    rule = (
        F.when((rain > 0) & (condition == "Thunderstorm"),
               advice(F.concat(F.lit("⛈️ Thunderstorm active ("), amount, F.lit("mm) → expect major delays")), "severe"))
        .when(rain > 5,
              advice(F.concat(F.lit("🌧️ Heavy rain ("), amount, F.lit("mm) → significant congestion increase")), "heavy"))
        .when(rain > 0,
              advice(F.concat(F.lit("🌧️ Light rain ("), amount, F.lit("mm) → expect slower traffic")), "moderate"))
    )
    for conditions, text, severity in fv.CONDITION_ADVISORIES:
        rule = rule.when(condition.isin(conditions), advice(text, severity))
    return rule.otherwise(
        advice(F.concat(F.lit("🌤️ "), condition, F.lit(" → monitoring traffic conditions")), "neutral"))


def relative_age(at: Column, as_of: Column) -> Column:
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(60e6))
    return (
        F.when(at.isNull(), F.lit("—"))
        .when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "),
                            (minutes % 60).cast("string"), F.lit("m ago")))
    )


def alert_severity(alert_type: Column) -> Column:
    """Part of ``severity:TYPE`` before the colon, ``info`` when there is none to read."""
    return F.coalesce(F.nullif(F.split_part(alert_type, F.lit(":"), F.lit(1)), F.lit("")), F.lit("info"))


def shortened(text: Column, length: int = 80) -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def delay_minutes(seconds: Column) -> Column:
    """Whole minutes, half up, 0 when there is no delay."""
    return F.when(seconds > 0, F.floor(seconds / 60 + F.lit(0.5))).otherwise(F.lit(0)).cast("bigint")
