"""Dashboard queries.  ``as_of`` (a timestamp column) takes the place of the wall clock.

Every time filter compares the stored column with a constant, so it prunes partitions and
row groups in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.numeric import percent_of, rounded, rounded_int
from roadweave.functions.texts import alert_severity
from roadweave.operators.band import nearest_in_band
from roadweave.operators.latest import latest_per_key, newest_rows, since

FEED_ROWS = 100


def _rows() -> Column:
    return F.count(F.lit(1))


def _right() -> Column:
    return F.col("predicted_congestion") == F.col("actual_congestion")


def _matches(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def latest_readings(readings: DataFrame, id_column: str = "reading_id") -> DataFrame:
    return latest_per_key(
        readings, ["location_name"], ["request_time", id_column],
        ["requested_lat", "requested_lon", "frc", "current_speed", "free_flow_speed", "confidence",
         "road_closure", "request_time"])


def latest_predictions(predictions: DataFrame, readings: DataFrame) -> DataFrame:
    """Newest prediction of each road with the road's newest reading; one row per road on both sides."""
    newest = latest_per_key(
        predictions, ["location_name"], ["predicted_at", "prediction_id"],
        ["predicted_congestion", "actual_congestion", "confidence", "top_reason_1", "top_reason_2",
         "top_reason_3", "predicted_at"])
    current = latest_readings(readings).select(
        "location_name", F.col("requested_lat").alias("lat"), F.col("requested_lon").alias("lon"),
        "current_speed", "free_flow_speed", "road_closure")
    return newest.join(current, "location_name")


def anomalies(table: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    recent = table.filter(since("detected_at", as_of, hours))
    return newest_rows(recent, [F.desc("detected_at"), F.desc("anomaly_id")], FEED_ROWS).select(
        "detected_at", "location_name", "anomaly_score", "current_speed", "free_flow_speed",
        "congestion_ratio", "reason")


def alerts(table: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    recent = table.filter(since("triggered_at", as_of, hours))
    return newest_rows(recent, [F.desc("triggered_at"), F.desc("alert_id")], FEED_ROWS).select(
        "triggered_at", "location_name", "alert_type", "message", "delivered")


def incidents_near_roads(readings: DataFrame, incidents: DataFrame, as_of: Column, hours: float = 2,
                         road_hours: float = 24) -> DataFrame:
    """Newest state of recent incidents, each road with its nearest one; newest first."""
    located = readings.filter(
        since("request_time", as_of, road_hours) & F.col("requested_lat").isNotNull() & F.col("requested_lon").isNotNull())
    roads = latest_per_key(located, ["location_name"], ["request_time", "reading_id"],
                           ["requested_lat", "requested_lon"]).select(
        "location_name", F.col("requested_lat").alias("lat"), F.col("requested_lon").alias("lon"))
    recent = incidents.filter(
        since("fetched_at", as_of, hours) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    newest = latest_per_key(recent, ["incident_id"], ["fetched_at", "row_id"])
    return nearest_in_band(roads, newest, "location_name", ["incident_id"]).orderBy(
        F.desc("fetched_at"), "near_road")


def aggregates(table: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    return table.filter(since("window_start", as_of, hours)).orderBy(F.desc("window_start"), "location_name")


def latest_weather(weather: DataFrame) -> DataFrame:
    return newest_rows(weather, [F.desc("recorded_at"), F.desc("weather_id")], 1).select(
        "recorded_at", "temperature", "feels_like", "humidity", "weather_main", "weather_desc", "wind_speed", "rain_mm")


def speed_history(readings: DataFrame, location: str, as_of: Column, hours: float = 24) -> DataFrame:
    return (
        readings.filter((F.col("location_name") == location) & since("request_time", as_of, hours))
        .select("request_time", "current_speed", "free_flow_speed", "confidence", "road_closure")
        .orderBy("request_time")
    )


def congestion_distribution(predictions: DataFrame, as_of: Column, days: float = 7) -> DataFrame:
    return (
        predictions.filter(since("predicted_at", as_of, days * 24))
        .groupBy(F.hour("predicted_at").alias("hour"), F.col("predicted_congestion").alias("level"))
        .agg(_rows().alias("count"))
        .orderBy("hour", "level")
    )


# forecasts ---------------------------------------------------------------------------


def latest_forecasts(readings: DataFrame, forecasts: DataFrame, as_of: Column,
                     reading_hours: float = 10 / 60, forecast_hours: float = 15 / 60) -> DataFrame:
    """Roads with a fresh reading and a map ``horizon -> forecast`` (NULL when none is fresh)."""
    current = latest_per_key(
        readings.filter(since("request_time", as_of, reading_hours)), ["location_name"],
        ["request_time", "reading_id"],
        ["current_speed", "free_flow_speed", "requested_lat", "requested_lon"])
    newest = latest_per_key(
        forecasts.filter(since("forecast_made_at", as_of, forecast_hours)), ["location_name", "horizon"],
        ["forecast_made_at", "forecast_id"],
        ["predicted_speed", "predicted_class", "confidence", "target_time", "forecast_made_at"])
    # at most one entry per horizon, so the list is as short as the list of horizons
    entry = F.struct("horizon", F.struct(
        "predicted_speed", "predicted_class", "confidence", "target_time", "forecast_made_at").alias("forecast"))
    documents = newest.groupBy("location_name").agg(F.map_from_entries(F.collect_list(entry)).alias("forecasts"))
    return current.join(documents, "location_name", "left").select(
        "location_name", "current_speed", "free_flow_speed", F.col("requested_lat").alias("lat"),
        F.col("requested_lon").alias("lon"), "forecasts")


def with_predicted_drop(forecast_rows: DataFrame, horizon: str = "60min") -> DataFrame:
    """``drop`` = current speed minus the forecast; 0 without a forecast."""
    later = F.try_element_at("forecasts", F.lit(horizon))["predicted_speed"]
    return forecast_rows.withColumn("drop", F.col("current_speed") - F.coalesce(later, F.col("current_speed")))


def sorted_forecasts(forecast_rows: DataFrame, by: str = "drop") -> DataFrame:
    order = {"name": [F.asc("location_name")],
             "current": [F.desc("current_speed"), F.asc("location_name")],
             "drop": [F.desc("drop"), F.asc("location_name")]}
    return with_predicted_drop(forecast_rows).orderBy(*order[by])


def biggest_drops(forecast_rows: DataFrame, count: int = 5) -> DataFrame:
    """Roads with the largest expected slow-down; a forecast of 0 counts as missing."""
    later = F.try_element_at("forecasts", F.lit("60min"))["predicted_speed"]
    shown = forecast_rows.filter(F.try_element_at("forecasts", F.lit("60min")).isNotNull()).withColumn(
        "drop", F.col("current_speed") - F.coalesce(F.nullif(later, F.lit(0.0)), F.col("current_speed")))
    return shown.orderBy(F.desc("drop"), "location_name").limit(count)


def warm_up_share(forecast_rows: DataFrame) -> DataFrame:
    share = F.when(_rows() > 0, F.count("forecasts") * F.lit(100.0) / _rows()).otherwise(F.lit(0.0))
    return forecast_rows.agg(_rows().alias("roads"), F.count("forecasts").alias("with_forecasts"),
                             rounded_int(share).alias("warmup_pct"))


def forecast_coverage(forecasts: DataFrame, as_of: Column, hours: float = 0.25) -> DataFrame:
    return (
        forecasts.filter(since("forecast_made_at", as_of, hours))
        .groupBy("horizon").agg(F.countDistinct("location_name").alias("locations"))
        .orderBy("horizon")
    )


# system health -----------------------------------------------------------------------


def accuracy(predictions: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    known = predictions.filter(since("predicted_at", as_of, hours) & F.col("actual_congestion").isNotNull())
    share = F.when(_rows() > 0, _matches(_right()) * F.lit(100.0) / _rows()).otherwise(F.lit(0.0))
    return known.agg(_rows().alias("total"), _matches(_right()).alias("correct"),
                     rounded(share, 1).alias("accuracy_pct"))


def accuracy_by_class(predictions: DataFrame, as_of: Column, hours: float = 24 * 7) -> DataFrame:
    known = predictions.filter(since("predicted_at", as_of, hours) & F.col("actual_congestion").isNotNull())
    return known.groupBy(F.col("actual_congestion").alias("level")).agg(
        _rows().alias("total"), _matches(_right()).alias("correct"),
        rounded_int(_matches(_right()) * F.lit(100.0) / _rows()).alias("accuracy_pct"))


def quality_pass_rate(quality: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    share = F.when(_rows() > 0, F.count_if("passed") * F.lit(100.0) / _rows()).otherwise(F.lit(100.0))
    return quality.filter(since("checked_at", as_of, hours)).agg(
        _rows().alias("total"), F.count_if("passed").alias("passed"), rounded(share, 1).alias("pass_rate"))


def freshness(readings: DataFrame, as_of: Column) -> DataFrame:
    age = (F.unix_micros(as_of) - F.unix_micros("last_reading")) / F.lit(1e6)
    return (
        readings.groupBy("location_name").agg(F.max("request_time").alias("last_reading"))
        .withColumn("age_seconds", age)
        .orderBy(F.desc("last_reading"))
    )


def recent_row_counts(tables: dict[str, tuple[DataFrame, str]], as_of: Column, hours: float) -> DataFrame:
    """Rows per table in the last hours: ``name -> (table, time column)``."""
    report = None
    for name, (df, column) in tables.items():
        part = df.filter(since(column, as_of, hours)).agg(_rows().alias("rows")).select(
            F.lit(name).alias("table_name"), "rows")
        report = part if report is None else report.unionByName(part)
    return report


def _day_and_day_before(df: DataFrame, column: str, as_of: Column, measures: dict[str, Column]) -> DataFrame:
    """The measures over the last day and over the day before it, in one scan.

    Long result ``(metric, period, value)``: one aggregate row per table, unpivoted.
    """
    period = F.when(since(column, as_of, 24), F.lit("today")).otherwise(F.lit("yesterday"))
    grouped = (
        df.filter(since(column, as_of, 48) & (F.col(column) <= as_of))
        .groupBy(period.alias("period")).agg(*[m.cast("double").alias(n) for n, m in measures.items()])
    )
    return grouped.unpivot("period", list(measures), "metric", "value")


def day_over_day(predictions: DataFrame, readings: DataFrame, quality: DataFrame, as_of: Column) -> DataFrame:
    """Change of volume (percent), accuracy and pass rate (points) against the day before."""
    known = predictions.filter(F.col("actual_congestion").isNotNull())
    hit = F.when(F.coalesce(_right(), F.lit(False)), 100.0).otherwise(0.0)
    passed = F.when(F.col("passed"), 100.0).otherwise(0.0)
    parts = (
        _day_and_day_before(readings, "request_time", as_of, {"records": _rows()})
        .unionByName(_day_and_day_before(known, "predicted_at", as_of, {"accuracy": F.avg(hit)}))
        .unionByName(_day_and_day_before(quality, "checked_at", as_of, {"quality": F.avg(passed)}))
    )

    def value(metric, period):
        return F.coalesce(F.max(F.when((F.col("metric") == metric) & (F.col("period") == period), F.col("value"))),
                          F.lit(0.0))

    today, before = value("records", "today"), value("records", "yesterday")
    return parts.agg(
        today.cast("bigint").alias("records_today"),
        before.cast("bigint").alias("records_yesterday"),
        rounded(F.when(before > 0, (today - before) / before * 100).otherwise(F.lit(0.0)), 1).alias("records_change_pct"),
        rounded(value("accuracy", "today") - value("accuracy", "yesterday"), 1).alias("accuracy_change_pct"),
        rounded(value("quality", "today") - value("quality", "yesterday"), 1).alias("api_change_pct"),
    )


def health(tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One row of system health; ``tables`` holds raw_events, predictions, anomalies,
    traffic_aggregates and data_quality_events.

    Each table is read once: one conditional aggregate over the span its measures need, all
    unpivoted and folded by a single small aggregate.
    """
    def measured(name, column, hours, measures):
        found = tables[name].filter(since(column, as_of, hours)).agg(*[m.cast("double").alias(n) for n, m in measures.items()])
        return found.unpivot([], list(measures), "measure", "value")

    def day(column):
        return since(column, as_of, 24)

    def today(column):
        return day(column) & (F.col(column) <= as_of)

    def yesterday(column):
        return ~day(column) & since(column, as_of, 48)

    def mean(value, condition):
        return F.avg(F.when(condition, value))

    known, right = F.col("actual_congestion").isNotNull(), F.coalesce(_right(), F.lit(False))
    hit, passed = F.when(right, 100.0).otherwise(0.0), F.when(F.col("passed"), 100.0).otherwise(0.0)
    at = "predicted_at"
    parts = (
        measured("raw_events", "request_time", 48, {
            "raw_events_24h": F.count_if(day("request_time")), "records_today": F.count_if(today("request_time")),
            "records_yesterday": F.count_if(yesterday("request_time"))})
        .unionByName(measured("predictions", at, 24 * 7, {
            "predictions_24h": F.count_if(day(at)), "accuracy_24h": mean(hit, known & day(at)),
            "accuracy_today": mean(hit, known & today(at)), "accuracy_yesterday": mean(hit, known & yesterday(at)),
            **{level: F.count_if(right & (F.col("actual_congestion") == level)) * 100.0
               / F.nullif(F.count_if(F.col("actual_congestion") == level), F.lit(0)) for level in fv.LEVELS}}))
        .unionByName(measured("anomalies", "detected_at", 24, {"anomalies_24h": F.count(F.lit(1))}))
        .unionByName(measured("traffic_aggregates", "window_start", 24, {"aggregations_24h": F.count(F.lit(1))}))
        .unionByName(measured("data_quality_events", "checked_at", 48, {
            "pass_rate": mean(passed, day("checked_at")), "quality_today": mean(passed, today("checked_at")),
            "quality_yesterday": mean(passed, yesterday("checked_at"))}))
    )

    def pick(name):
        return F.max(F.when(F.col("measure") == name, F.col("value")))

    def change(name):
        return rounded(F.coalesce(pick(f"{name}_today"), F.lit(0.0)) - F.coalesce(pick(f"{name}_yesterday"), F.lit(0.0)), 1)

    now, before = pick("records_today"), pick("records_yesterday")
    return parts.agg(
        *[pick(n).cast("bigint").alias(n) for n in ("raw_events_24h", "predictions_24h", "anomalies_24h", "aggregations_24h")],
        rounded(F.coalesce(pick("accuracy_24h"), F.lit(0.0)), 1).alias("accuracy_24h"),
        rounded(F.coalesce(pick("pass_rate"), F.lit(100.0)), 1).alias("api_success_rate"),
        rounded(F.when(before > 0, (now - before) / before * 100).otherwise(F.lit(0.0)), 1).alias("records_change_pct"),
        change("accuracy").alias("accuracy_change_pct"), change("quality").alias("api_change_pct"),
        *[rounded_int(pick(level)).alias("accuracy_" + level.lower().replace(" ", "_")) for level in fv.LEVELS],
    )


# summaries ---------------------------------------------------------------------------


def latest_summary(summaries: DataFrame) -> DataFrame:
    """Newest summary that did not fail."""
    good = summaries.filter(F.coalesce("error", F.lit("")) == "")
    return newest_rows(good, [F.desc("generated_at")], 1).select(
        "generated_at", "summary_text", "snapshot_data", "tokens_in", "tokens_out", "elapsed_ms", "cached", "error")


# data quality ------------------------------------------------------------------------


def quality_overview(quality: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """Totals of the period; a score that is missing *or zero* is shown as 100."""

    def or_100(value):
        return F.coalesce(F.nullif(value.cast("bigint"), F.lit(0)), F.lit(100))

    total = _rows()
    return quality.filter(since("checked_at", as_of, hours)).agg(
        total.alias("total_messages"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("passed") & (F.col("issues_count") > 0)).alias("warnings"),
        rounded(F.when(total > 0, F.count_if("passed") * F.lit(100.0) / total).otherwise(F.lit(0.0)), 1).alias("pass_rate"),
        or_100(rounded_int(F.avg("quality_score"))).alias("avg_score"),
        or_100(F.min("quality_score")).alias("min_score"),
        or_100(F.max("quality_score")).alias("max_score"),
    )


def top_issues(quality: DataFrame, as_of: Column, hours: float = 24, count: int = 5) -> DataFrame:
    return (
        quality.filter(since("checked_at", as_of, hours))
        .select(F.explode("issues").alias("issue"))
        .groupBy(F.col("issue.check").alias("check_name"), F.col("issue.severity").alias("severity"))
        .agg(_rows().alias("count"))
        .orderBy(F.desc("count"), "check_name", "severity").limit(count)
    )


def top_problem_roads(quality: DataFrame, as_of: Column, hours: float = 24, count: int = 5) -> DataFrame:
    return (
        quality.filter(since("checked_at", as_of, hours) & (F.col("issues_count") > 0))
        .groupBy("location_name")
        .agg(_rows().alias("check_count"), F.sum("issues_count").alias("total_issues"),
             rounded_int(F.avg("quality_score")).alias("avg_score"))
        .orderBy(F.desc("total_issues"), "location_name").limit(count)
    )


def quality_events(quality: DataFrame, as_of: Column, hours: float = 24, only_issues: bool = False) -> DataFrame:
    recent = quality.filter(since("checked_at", as_of, hours))
    if only_issues:
        recent = recent.filter(F.col("issues_count") > 0)
    return newest_rows(recent, [F.desc("checked_at"), F.desc("event_id")], FEED_ROWS).select(
        "checked_at", "location_name", "quality_score", "passed", "issues_count", "issues")


def quality_totals(checked: DataFrame) -> DataFrame:
    """Running totals over everything checked so far."""
    ok = F.col("passed")
    return checked.agg(
        _rows().alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.col("issues_count") > 0)).alias("warnings"),
        F.count_if("fatal").alias("fatal"), percent_of(ok).alias("pass_rate"))


def issue_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("issues.check").alias("check_name")).groupBy("check_name").agg(
        _rows().alias("count"))


def top_checks(checked: DataFrame, count: int = 3) -> DataFrame:
    return issue_counts(checked).orderBy(F.desc("count"), "check_name").limit(count)


# current state -----------------------------------------------------------------------


def operational_kpis(latest: DataFrame) -> DataFrame:
    """Figures over one row per road (newest prediction with newest reading)."""
    level, total = F.col("predicted_congestion"), _rows()

    def share(value):
        return F.when(total > 0, value).otherwise(F.lit(0.0))

    severe = level.isin("Severe", "Closed") | F.col("road_closure")
    return latest.agg(
        total.alias("roads"),
        F.count_if("road_closure").alias("closures"),
        rounded_int(share(F.sum(F.coalesce("current_speed", F.lit(0.0))) / total)).alias("avg_speed"),
        rounded_int(share(_matches(level == "Free Flow") * F.lit(100.0) / total)).alias("free_flow_pct"),
        _matches(severe).alias("severe_count"),
        rounded_int(share(F.sum(F.when(F.col("free_flow_speed") > 0, F.col("current_speed") / F.col("free_flow_speed"))
                                .otherwise(F.lit(0.0))) / total * 100)).alias("avg_ratio_pct"),
    )


def level_shares(latest: DataFrame, level: str = "predicted_congestion") -> DataFrame:
    """Count and share of every class, classes without a road included."""
    total = _rows()
    counts = latest.agg(
        total.alias("total"),
        *[_matches(F.col(level) == name).alias(name) for name in fv.LEVELS])
    share = F.when(F.col("total") > 0, F.col("count") * F.lit(100.0) / F.col("total")).otherwise(F.lit(0.0))
    return counts.unpivot("total", fv.LEVELS, "level", "count").select(
        "level", "count", rounded_int(share).alias("pct"))


def worst_roads(latest: DataFrame, count: int = 5) -> DataFrame:
    return (
        latest.filter(F.col("free_flow_speed") > 0)
        .withColumn("ratio", F.col("current_speed") / F.col("free_flow_speed"))
        .orderBy("ratio", "location_name").limit(count)
    )


def slowest_roads(latest: DataFrame, count: int = 5) -> DataFrame:
    return latest.orderBy("current_speed", "location_name").limit(count)


def combined_feed(anomaly_rows: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Anomalies and alerts in one list, newest first, each with a severity and a text."""

    def text(column, default):
        return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))

    found = anomaly_rows.select(
        F.lit("anomaly").alias("type"), text(F.col("location_name"), "Unknown").alias("location"),
        text(F.col("reason"), "Unusual traffic pattern detected").alias("message"),
        F.col("detected_at").alias("time"), F.lit("anomaly").alias("severity"),
        F.col("current_speed").alias("speed"), F.col("free_flow_speed").alias("free_flow"),
        F.col("anomaly_score").alias("score"))
    raised = alert_rows.select(
        F.lit("alert").alias("type"), text(F.col("location_name"), "Unknown").alias("location"),
        text(F.col("message"), "Alert triggered").alias("message"),
        F.col("triggered_at").alias("time"), alert_severity(F.col("alert_type")).alias("severity"))
    return found.unionByName(raised, allowMissingColumns=True).orderBy(F.desc("time"), "type", "location", "message")


def feed_counts(feed: DataFrame) -> DataFrame:
    return feed.groupBy("type").agg(_rows().alias("count"))


def hourly_speed_pivot(readings: DataFrame, roads: list[str], as_of: Column, hours: float = 24) -> DataFrame:
    """Mean speed by hour, one column per chosen road."""
    return (
        readings.filter(since("request_time", as_of, hours) & F.col("location_name").isin(roads))
        .groupBy(F.hour("request_time").alias("hour"))
        .agg(*[rounded(F.avg(F.when(F.col("location_name") == r, F.col("current_speed"))), 1).alias(r) for r in roads])
    )


def hourly_level_pivot(readings: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    return (
        readings.filter(since("request_time", as_of, hours))
        .groupBy(F.hour("request_time").alias("hour"))
        .agg(*[_matches(F.col("congestion_level") == level).alias(level) for level in fv.LEVELS])
    )

