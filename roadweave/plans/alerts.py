"""Alerts over scored readings: rounds, new closures, city state, suppression of repeats.

A round is a time bucket of the polling interval.  That makes it independent of the order in
which readings arrive, so rounds are evaluated in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions import alerts as rules
from roadweave.functions.lookups import poll_interval
from roadweave.operators.cooldown import suppress_repeats


def round_start(ts: Column, seconds: int | None = None, tz: str = fv.POLL_TIMEZONE) -> Column:
    """Start of the polling round of an instant; the schedule's interval unless ``seconds`` is given.

    The scheduled intervals divide the hour and change on the hour, so plain flooring is right.
    """
    interval = F.lit(seconds) if seconds else poll_interval(ts, tz)["seconds"]
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / interval) * interval)


def previous_round(start: Column, seconds: int | None = None, tz: str = fv.POLL_TIMEZONE) -> Column:
    return round_start(start - F.expr("INTERVAL 1 SECOND"), seconds, tz)


def with_round(readings: DataFrame, seconds: int | None = None, ts: str = "request_time") -> DataFrame:
    return readings.withColumn("round_start", round_start(F.col(ts), seconds))


def closed_rounds(rounds: DataFrame) -> DataFrame:
    """(road, round) pairs in which the road was closed."""
    return rounds.filter(F.col("road_closure")).select("location_name", "round_start").distinct()


def new_closures(rounds: DataFrame, seconds: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Closed readings of roads that were not closed in the round before (absent = not closed).

    Only closed readings take part, so the join moves a small share of the data.  ``earlier``
    adds pairs of ``closed_rounds`` that were seen before this batch.
    """
    closed = rounds.filter(F.col("road_closure"))
    known = closed_rounds(rounds)
    known = known if earlier is None else known.unionByName(earlier.select("location_name", "round_start"))
    before = known.withColumnRenamed("round_start", "_previous")
    return (
        closed.withColumn("_previous", previous_round(F.col("round_start"), seconds))
        .join(before, ["location_name", "_previous"], "left_anti").drop("_previous")
    )


def city_rounds(rounds: DataFrame) -> DataFrame:
    """Class counts and congested share (unrounded) of every round."""
    level = F.col("predicted_congestion")
    congested = level.isin(fv.LEVELS[1:])
    return rounds.groupBy("round_start").agg(
        F.max("request_time").alias("request_time"), F.max("reading_id").alias("reading_id"),
        F.count(F.lit(1)).alias("roads"),
        *[F.count_if(F.coalesce(level == name, F.lit(False))).alias(name) for name in fv.LEVELS],
        (F.count_if(F.coalesce(congested, F.lit(False))) * F.lit(100.0) / F.count(F.lit(1))).alias("pct"),
    )


def _rows(df: DataFrame, alerts: list[Column], place: Column) -> DataFrame:
    """Explode the alerts of each row; ``alert_id`` = 4 * reading id + position of the rule."""
    numbered = F.array_compact(F.array(*[
        F.when(a.isNotNull(), F.struct(F.lit(n).alias("rule"), a.alias("alert"))) for n, a in enumerate(alerts)]))
    return df.select(
        "reading_id", F.col("request_time").alias("triggered_at"), place.alias("location_name"),
        F.explode(numbered).alias("_a"),
    ).select(
        (F.col("reading_id") * 4 + F.col("_a.rule")).alias("alert_id"), "triggered_at", "location_name",
        F.col("_a.alert.kind").alias("kind"), F.col("_a.alert.severity").alias("severity"),
        F.col("_a.alert.alert_type").alias("alert_type"), F.col("_a.alert.message").alias("message"),
    )


def reading_alerts(scored: DataFrame) -> DataFrame:
    """Alerts that depend on one reading alone: anomaly and congestion."""
    place = F.coalesce("location_name", F.lit("Unknown"))
    return _rows(scored, [rules.anomaly_alert(), rules.congestion_alert()], place)


def raised_alerts(scored: DataFrame, seconds: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Every alert condition met, before repeats are suppressed.

    Needs the scored reading: ``reading_id, request_time, location_name, predicted_congestion,
    is_anomaly, anomaly_score, anomaly_reason, is_rush_hour, hour, road_closure`` and both speeds.
    """
    return reading_alerts(scored).unionByName(round_alerts(scored, seconds, earlier))


def round_alerts(scored: DataFrame, seconds: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Alerts that depend on whole rounds: new closures and the state of the city."""
    none = F.lit(None)
    place = F.coalesce("location_name", F.lit("Unknown"))
    rounds = with_round(scored, seconds)
    closures = _rows(new_closures(rounds, seconds, earlier).withColumn("is_new_closure", F.lit(True)),
                     [none, none, rules.closure_alert()], place)
    city = _rows(city_rounds(rounds), [none, none, none, rules.city_alert()], F.lit(fv.CITY_ALERT_PLACE))
    return closures.unionByName(city)


def sent_alerts(scored: DataFrame, seconds: int | None = None,
                cooldown_seconds: int = fv.COOLDOWN_MINUTES * 60) -> DataFrame:
    """Alerts that remain when a (kind, road) stays silent for the cooldown after each one sent."""
    raised = raised_alerts(scored, seconds)
    return suppress_repeats(raised, ["kind", "location_name"], "triggered_at", "alert_id", cooldown_seconds)


def alert_statistics(sent: DataFrame, as_of: Column, cooldown_seconds: int = fv.COOLDOWN_MINUTES * 60) -> DataFrame:
    """Alerts sent so far and (kind, road) pairs still remembered: twice the cooldown."""
    age = F.unix_seconds(as_of) - F.unix_seconds(F.max("triggered_at"))
    return (
        sent.groupBy("kind", "location_name").agg(F.count(F.lit(1)).alias("n"), age.alias("age"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
             F.count_if(F.col("age") <= 2 * cooldown_seconds).alias("active_cooldowns"))
    )
