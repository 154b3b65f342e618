"""CASE expressions and literal maps generated from the fixed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import safe_ratio


def code_name(code: Column, names: Mapping, default: str | Column = "Unknown") -> Column:
    """Code -> name through a literal map; unknown and NULL codes give ``default``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(table, code), fallback)


def between_case(value: Column, ranges: Iterable[tuple], otherwise=None) -> Column:
    """Ranges ``(first, last, label)`` with inclusive bounds -> label."""
    case = None
    for first, last, label in ranges:
        test = value.between(first, last)
        case = F.when(test, F.lit(label)) if case is None else case.when(test, F.lit(label))
    return case if otherwise is None else case.otherwise(F.lit(otherwise))


def floor_case(value: Column, floors: Iterable[tuple], lowest: str) -> Column:
    case = None
    for floor, label in floors:
        test = value >= F.lit(floor)
        case = F.when(test, F.lit(label)) if case is None else case.when(test, F.lit(label))
    return case.otherwise(F.lit(lowest))


def incident_type(code: Column) -> Column:
    return code_name(code.cast("int"), fv.INCIDENT_TYPES)


def delay_magnitude(code: Column) -> Column:
    return code_name(code.cast("int"), fv.DELAY_MAGNITUDES)


def road_type(frc: Column) -> Column:
    return code_name(frc, fv.ROAD_TYPES)


def check_label(check: Column) -> Column:
    return code_name(check, fv.CHECK_LABELS, default=check)


def congestion_ratio(current: Column, free_flow: Column) -> Column:
    return safe_ratio(current, free_flow)


def congestion_level(ratio: Column, closed: Column) -> Column:
    """Canonical five classes; a NULL ratio ends in the lowest class, a NULL flag is open."""
    return F.when(closed, F.lit("Closed")).otherwise(floor_case(ratio, fv.LEVEL_FLOORS, "Severe"))


def eda_level(ratio: Column) -> Column:
    """Exploration classes: finer cuts and ``Unknown`` for a missing ratio."""
    return F.when(ratio.isNull(), F.lit("Unknown")).otherwise(
        floor_case(ratio, fv.EDA_LEVEL_FLOORS, "Severe")
    )


def is_rush_hour(hour: Column) -> Column:
    (a, b), (c, d) = fv.RUSH_HOURS
    return hour.between(a, b) | hour.between(c, d)


def is_forecast_rush_hour(hour: Column, weekend: Column) -> Column:
    return ~weekend & hour.isin(fv.FORECAST_RUSH_HOURS)


def time_period_name(hour: Column) -> Column:
    return between_case(hour, fv.TIME_PERIODS)


def time_period_code(hour: Column) -> Column:
    return between_case(hour, fv.TIME_PERIOD_CODES)


def instant(df: DataFrame, column: str) -> Column:
    """Timestamp of a column that may be ISO text; unreadable text gives NULL."""
    value = F.col(column)
    return F.try_to_timestamp(value) if df.schema[column].dataType.typeName() == "string" else value.cast("timestamp")


def sunday_first(ts: Column) -> Column:
    """Day of week with Sunday = 0 (warehouse convention)."""
    return F.dayofweek(ts) - 1


def poll_interval(ts: Column, tz: str | None = fv.POLL_TIMEZONE) -> Column:
    """Struct ``(seconds, label)`` of the polling schedule at a UTC instant.

    ``tz=None`` takes the value as local time already.
    """
    hour = F.hour(ts if tz is None else F.from_utc_timestamp(ts, tz))
    seconds, label = fv.POLL_DEFAULT
    return F.struct(
        between_case(hour, [(a, b - 1, s) for a, b, s, _ in fv.POLL_SCHEDULE], seconds).alias("seconds"),
        between_case(hour, [(a, b - 1, t) for a, b, _, t in fv.POLL_SCHEDULE], label).alias("label"),
    )


def horizon_minutes(horizon: Column) -> Column:
    return F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for p in fv.HORIZON_MINUTES.items() for x in p]), horizon
        ),
        F.lit(0),
    )


def target_time(made_at: Column, horizon: Column) -> Column:
    """When a forecast made at ``made_at`` falls due; an unknown horizon adds nothing."""
    return made_at + F.make_interval(mins=horizon_minutes(horizon))


# score and rate bands used by the reports --------------------------------------


def score_band(score: Column) -> Column:
    return floor_case(score, [(95, "free"), (80, "moderate"), (50, "heavy")], "severe")


def pass_rate_band(rate: Column) -> Column:
    return floor_case(rate, [(99, "free"), (90, "moderate")], "severe")


def trend_band(drop: Column) -> Column:
    return F.when(drop > 5, "down").when(drop < -5, "up").otherwise("flat")


def kpi_band(percent: Column) -> Column:
    return floor_case(percent, [(75, "Free Flow"), (50, "Moderate")], "Congested")
