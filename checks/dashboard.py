"""Dashboard queries.  The look-backs fit the density of the given events (hours instead of minutes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.sql import (ALERTS, ANOMALIES, AS_OF, FORECASTS, INCIDENTS, PREDICTIONS, QUALITY, SCORED, SUMMARIES, WEATHER,
                        WINDOWS, pct, r, ri, ts)
from roadweave.functions import texts
from roadweave.functions.numeric import rounded
from roadweave.plans import dashboard

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


def ago(column: str, hours: float) -> str:
    return f"{column} > {AS_OF} - interval {hours} hours"


_LATEST = f"""lr as (select distinct on (location_name) * from sc order by location_name, request_time desc, reading_id desc)"""
_NEWEST = f"""np as (select distinct on (location_name) * from pr order by location_name, predicted_at desc, prediction_id desc),
 cur as (select np.*, lr.requested_lat as lat, lr.requested_lon as lon, lr.current_speed, lr.free_flow_speed, lr.road_closure
   from np join lr using (location_name))"""


def current(spark, path):
    return dashboard.latest_predictions(t.predictions(spark, path), t.readings(spark, path))


@query("d01_latest_predictions", f"""with {PREDICTIONS}, {_LATEST}, {_NEWEST}
select location_name, predicted_congestion, actual_congestion, confidence, top_reason_1, top_reason_2, top_reason_3,
  {ts('predicted_at')} as predicted_at, lat, lon, current_speed, free_flow_speed, road_closure from cur""")
def latest_predictions(spark, path):
    return current(spark, path)


@query("d02_anomalies", f"""with {ANOMALIES}
select {ts('detected_at')} as detected_at, location_name, anomaly_score, current_speed, free_flow_speed, congestion_ratio, reason
from an where {ago('an.detected_at', 24)} order by an.detected_at desc, anomaly_id desc limit 100""")
def anomalies(spark, path):
    return dashboard.anomalies(t.anomalies(spark, path), t.as_of())


@query("d03_alerts", f"""with {ALERTS}
select {ts('triggered_at')} as triggered_at, location_name, alert_type, message, delivered
from al where {ago('al.triggered_at', 24)} order by al.triggered_at desc, alert_id desc limit 100""")
def alerts(spark, path):
    return dashboard.alerts(t.alerts(spark, path), t.as_of())


@query("d04_incidents_near_roads", f"""with {SCORED}, {INCIDENTS},
 ml as (select distinct on (location_name) location_name, requested_lat as lat, requested_lon as lon from sc
   where {ago('request_time', 720)} order by location_name, request_time desc, reading_id desc),
 ri as (select distinct on (incident_id) * from inc where {ago('fetched_at', 720)} order by incident_id, fetched_at desc, row_id desc),
 mt as (select ri.*, ml.location_name as near_road, abs(ri.lat - ml.lat) + abs(ri.lon - ml.lon) as distance,
    row_number() over (partition by ml.location_name order by abs(ri.lat - ml.lat) + abs(ri.lon - ml.lon), incident_id) as rn
   from ri join ml on abs(ri.lat - ml.lat) < 0.002e0 and abs(ri.lon - ml.lon) < 0.002e0)
select incident_id, incident_type, cast(icon_category as bigint) as icon_category, delay_seconds, {ts('fetched_at')} as fetched_at, row_id,
  {r('lat', 5)} as lat, {r('lon', 5)} as lon, near_road, {r('distance', 5)} as distance from mt where rn = 1""")
def incidents_near_roads(spark, path):
    found = dashboard.incidents_near_roads(
        t.readings(spark, path), t.incidents(spark, path), t.as_of(), hours=720, road_hours=720)
    return found.withColumns({c: rounded(F.col(c), 5) for c in ("lat", "lon", "distance")})


@query("d05_aggregates", f"""with {WINDOWS}
select {ts('window_start')} as window_start, {ts('window_end')} as window_end, location_name, avg_speed, min_speed, max_speed,
  avg_free_flow_speed, avg_congestion_ratio, reading_count, closure_count from win where {ago('win.window_start', 240)}""")
def aggregates(spark, path):
    return dashboard.aggregates(t.aggregates(spark, path), t.as_of(), hours=240)


@query("a09_road_windows", f"""with {WINDOWS}
select {ts('window_start')} as window_start, {ts('window_end')} as window_end, location_name, avg_speed, min_speed, max_speed,
  avg_free_flow_speed, avg_congestion_ratio, reading_count, closure_count from win""")
def road_windows(spark, path):
    return t.aggregates(spark, path)


@query("d06_latest_weather", f"""with {WEATHER}
select {ts('recorded_at')} as recorded_at, temperature, feels_like, cast(humidity as bigint) as humidity, weather_main, weather_desc,
  wind_speed, rain_mm from we order by we.recorded_at desc, weather_id desc limit 1""")
def latest_weather(spark, path):
    return dashboard.latest_weather(t.weather(spark, path))


_HIT = "predicted_congestion = actual_congestion"
_HEALTH = f"""{PREDICTIONS}, hx as (select 1),
 a1 as (select count(*) as total, count(*) filter (where {_HIT}) as correct from pr where {ago('predicted_at', 24)} and actual_congestion is not null)"""


@query("a27_accuracy", f"""with {PREDICTIONS}
select count(*) as total, count(*) filter (where {_HIT}) as correct, {pct(_HIT)} as accuracy_pct from pr where {ago('predicted_at', 24)}""")
def accuracy(spark, path):
    return dashboard.accuracy(t.predictions(spark, path), t.as_of())


@query("a28_accuracy_by_class", f"""with {PREDICTIONS}
select actual_congestion as level, count(*) as total, count(*) filter (where {_HIT}) as correct,
  {ri(f'count(*) filter (where {_HIT}) * 1e2 / count(*)')} as accuracy_pct from pr where {ago('predicted_at', 168)} group by 1""")
def accuracy_by_class(spark, path):
    return dashboard.accuracy_by_class(t.predictions(spark, path), t.as_of())


def _day(column, first, last=None):
    upper = "" if last is None else f" and {column} <= {AS_OF} - interval {last} hours"
    return f"{column} > {AS_OF} - interval {first} hours{upper}"


_QUALITY_TAIL = QUALITY[QUALITY.index(", ms as"):]
_DELTAS = f"""(select count(*) from rd where {_day('request_time', 24)}) as records_today,
  (select count(*) from rd where {_day('request_time', 48, 24)}) as records_yesterday,
  (select coalesce(avg(case when {_HIT} then 1e2 else 0e0 end), 0) from pr where {_day('predicted_at', 24)}) as acc_today,
  (select coalesce(avg(case when {_HIT} then 1e2 else 0e0 end), 0) from pr where {_day('predicted_at', 48, 24)}) as acc_yesterday,
  (select coalesce(avg(case when passed then 1e2 else 0e0 end), 0) from ql where {_day('checked_at', 24)} and checked_at <= {AS_OF}) as dq_today,
  (select coalesce(avg(case when passed then 1e2 else 0e0 end), 0) from ql where {_day('checked_at', 48, 24)}) as dq_yesterday"""


@query("a30_day_over_day", f"""with {PREDICTIONS}{_QUALITY_TAIL}, dl as (select {_DELTAS})
select records_today, records_yesterday,
  {r('case when records_yesterday > 0 then (records_today - records_yesterday) * 1e2 / records_yesterday else 0e0 end', 1)} as records_change_pct,
  {r('acc_today - acc_yesterday', 1)} as accuracy_change_pct, {r('dq_today - dq_yesterday', 1)} as api_change_pct from dl""")
def day_over_day(spark, path):
    return dashboard.day_over_day(t.predictions(spark, path), t.readings(spark, path), t.quality(spark, path), t.as_of())


_COUNTS = [("raw_events", "rd", "request_time"), ("predictions", "pr", "predicted_at"), ("anomalies", "an", "detected_at"),
           ("forecasts", "fc", "forecast_made_at"), ("ai_summaries", "su", "generated_at"),
           ("data_quality_events", "ql", "checked_at"), ("fact_traffic", "rd", "request_time")]
_TAIL = {
    "pr": PREDICTIONS[PREDICTIONS.index(", pr as"):], "an": ANOMALIES[ANOMALIES.index(", v0 as"):],
    "fc": FORECASTS[FORECASTS.index(", lg as"):], "su": SUMMARIES[SUMMARIES.index(", su as"):],
    "win": WINDOWS[WINDOWS.index(", win as"):],
}


@query("a31_recent_row_counts", f"with {SCORED}{_TAIL['pr']}{_TAIL['an']}{_TAIL['fc']}{_TAIL['su']}{_QUALITY_TAIL} " + " union all ".join(
    f"select '{n}' as table_name, count(*) as rows from {table} where {ago(c, 6)}" for n, table, c in _COUNTS))
def recent_row_counts(spark, path):
    tables = {
        "raw_events": (t.readings(spark, path), "request_time"), "predictions": (t.predictions(spark, path), "predicted_at"),
        "anomalies": (t.anomalies(spark, path), "detected_at"), "forecasts": (t.forecasts(spark, path), "forecast_made_at"),
        "ai_summaries": (t.summaries(spark, path), "generated_at"), "data_quality_events": (t.quality(spark, path), "checked_at"),
        "fact_traffic": (t.fact(spark, path), "event_time"),
    }
    return dashboard.recent_row_counts(tables, t.as_of(), 6)


@query("a32_freshness", f"""with {SCORED}
select location_name, {ts('max(request_time)')} as last_reading, (epoch_us({AS_OF}) - epoch_us(max(request_time))) / 1e6 as age_seconds
from sc group by 1""")
def freshness(spark, path):
    return dashboard.freshness(t.readings(spark, path), t.as_of())


_LEVEL_COLUMNS = ", ".join(
    f"(select {ri(f'count(*) filter (where {_HIT}) * 1e2 / nullif(count(*), 0)')} from pr where {ago('predicted_at', 168)} and actual_congestion = '{level}') as accuracy_{level.lower().replace(' ', '_')}"
    for level in ("Free Flow", "Moderate", "Heavy", "Severe", "Closed"))


@query("d07_health", f"""with {SCORED}{_TAIL['pr']}{_TAIL['an']}{_TAIL['win']}{_QUALITY_TAIL}, dl as (select {_DELTAS})
select records_today as raw_events_24h, (select count(*) from pr where {ago('predicted_at', 24)}) as predictions_24h,
  (select count(*) from an where {ago('detected_at', 24)}) as anomalies_24h, (select count(*) from win where {ago('window_start', 24)}) as aggregations_24h,
  (select {pct(_HIT)} from pr where {ago('predicted_at', 24)}) as accuracy_24h, (select {pct('passed')} from ql where {ago('checked_at', 24)}) as api_success_rate,
  {r('case when records_yesterday > 0 then (records_today - records_yesterday) * 1e2 / records_yesterday else 0e0 end', 1)} as records_change_pct,
  {r('acc_today - acc_yesterday', 1)} as accuracy_change_pct, {r('dq_today - dq_yesterday', 1)} as api_change_pct, {_LEVEL_COLUMNS} from dl""")
def health(spark, path):
    return dashboard.health({
        "raw_events": t.readings(spark, path), "predictions": t.predictions(spark, path),
        "anomalies": t.anomalies(spark, path), "traffic_aggregates": t.aggregates(spark, path),
        "data_quality_events": t.quality(spark, path)}, t.as_of())


@query("d08_latest_readings", f"""with {SCORED}, {_LATEST}
select location_name, requested_lat, requested_lon, frc, current_speed, free_flow_speed, confidence, road_closure,
  {ts('request_time')} as request_time from lr""")
def latest_readings(spark, path):
    return dashboard.latest_readings(t.readings(spark, path))


@query("d09_speed_history", f"""with {SCORED}
select {ts('request_time')} as request_time, current_speed, free_flow_speed, confidence, road_closure from sc
where location_name = 'Road 07' and {ago('sc.request_time', 240)}""")
def speed_history(spark, path):
    return dashboard.speed_history(t.readings(spark, path), "Road 07", t.as_of(), hours=240)


@query("d10_congestion_distribution", f"""with {PREDICTIONS}
select extract(hour from predicted_at) as hour, predicted_congestion as level, count(*) as count from pr where {ago('predicted_at', 168)} group by 1, 2""")
def congestion_distribution(spark, path):
    return dashboard.congestion_distribution(t.predictions(spark, path), t.as_of())


_FRESH = f"""lf as (select distinct on (location_name, horizon) * from fc where {ago('forecast_made_at', 6)}
   order by location_name, horizon, forecast_made_at desc, forecast_id desc),
 cs as (select distinct on (location_name) * from sc where {ago('request_time', 12)} order by location_name, request_time desc, reading_id desc),
 fl as (select cs.location_name, cs.current_speed, cs.free_flow_speed, cs.requested_lat as lat, cs.requested_lon as lon,
   max(case when horizon = '20min' then predicted_speed end) as speed_20, max(case when horizon = '30min' then predicted_speed end) as speed_30,
   max(case when horizon = '60min' then predicted_speed end) as speed_60, max(case when horizon = '60min' then predicted_class end) as class_60,
   max(case when horizon = '60min' then {ts('target_time')} end) as target_60, count(horizon) as horizons
  from cs left join lf on lf.location_name = cs.location_name group by all)"""


def forecast_list(spark, path):
    return dashboard.latest_forecasts(t.readings(spark, path), t.forecasts(spark, path), t.as_of(), reading_hours=12, forecast_hours=6)


@query("d11_latest_forecasts", f"with {FORECASTS}, {_FRESH} select *, horizons > 0 as has_forecasts from fl")
def latest_forecasts(spark, path):
    at = {h: F.try_element_at("forecasts", F.lit(h)) for h in ("20min", "30min", "60min")}
    return forecast_list(spark, path).select(
        "location_name", "current_speed", "free_flow_speed", "lat", "lon", at["20min"]["predicted_speed"].alias("speed_20"),
        at["30min"]["predicted_speed"].alias("speed_30"), at["60min"]["predicted_speed"].alias("speed_60"),
        at["60min"]["predicted_class"].alias("class_60"), at["60min"]["target_time"].alias("target_60"),
        F.coalesce(F.size("forecasts"), F.lit(0)).cast("bigint").alias("horizons"), F.col("forecasts").isNotNull().alias("has_forecasts"))


@query("a37_forecast_coverage", f"with {FORECASTS} select horizon, count(distinct location_name) as locations from fc where {ago('forecast_made_at', 6)} group by 1")
def forecast_coverage(spark, path):
    return dashboard.forecast_coverage(t.forecasts(spark, path), t.as_of(), hours=6)


@query("a41_warm_up_share", f"""with {FORECASTS}, {_FRESH}
select count(*) as roads, count(*) filter (where horizons > 0) as with_forecasts, {ri('count(*) filter (where horizons > 0) * 1e2 / count(*)')} as warmup_pct from fl""")
def warm_up_share(spark, path):
    return dashboard.warm_up_share(forecast_list(spark, path))


@query("w14_sorted_forecasts", f"""with {FORECASTS}, {_FRESH}
select location_name, current_speed, {r('current_speed - coalesce(speed_60, current_speed)', 2)} as "drop" from fl""")
def sorted_forecasts(spark, path):
    return dashboard.sorted_forecasts(forecast_list(spark, path)).select(
        "location_name", "current_speed", rounded(F.col("drop"), 2).alias("drop"))


@query("w14_biggest_drops", f"""with {FORECASTS}, {_FRESH}
select location_name, {r('current_speed - coalesce(nullif(speed_60, 0), current_speed)', 2)} as "drop" from fl where speed_60 is not null
order by current_speed - coalesce(nullif(speed_60, 0), current_speed) desc, location_name limit 5""")
def biggest_drops(spark, path):
    return dashboard.biggest_drops(forecast_list(spark, path)).select("location_name", rounded(F.col("drop"), 2).alias("drop"))


@query("d12_latest_summary", f"""with {SUMMARIES}
select {ts('generated_at')} as generated_at, summary_text, snapshot_data, tokens_in, tokens_out, elapsed_ms, cached, error
from su where error is null or error = '' order by su.generated_at desc limit 1""")
def latest_summary(spark, path):
    return dashboard.latest_summary(t.summaries(spark, path))


@query("a38_operational_kpis", f"""with {PREDICTIONS}, {_LATEST}, {_NEWEST}
select count(*) as roads, count(*) filter (where road_closure) as closures, {ri('sum(coalesce(current_speed, 0)) / count(*)')} as avg_speed,
  {ri("count(*) filter (where predicted_congestion = 'Free Flow') * 1e2 / count(*)")} as free_flow_pct,
  count(*) filter (where predicted_congestion in ('Severe', 'Closed') or road_closure) as severe_count,
  {ri('sum(case when free_flow_speed > 0 then current_speed / free_flow_speed else 0 end) / count(*) * 100')} as avg_ratio_pct from cur""")
def operational_kpis(spark, path):
    return dashboard.operational_kpis(current(spark, path))


@query("a40_level_shares", f"""with {PREDICTIONS}, {_LATEST}, {_NEWEST}
select v.level, count(cur.location_name) as count, {ri('count(cur.location_name) * 1e2 / (select count(*) from cur)')} as pct
from (values ('Free Flow'), ('Moderate'), ('Heavy'), ('Severe'), ('Closed')) v(level) left join cur on predicted_congestion = v.level group by 1""")
def level_shares(spark, path):
    return dashboard.level_shares(current(spark, path))


@query("w12_worst_roads", f"""with {PREDICTIONS}, {_LATEST}, {_NEWEST}
select location_name, current_speed, free_flow_speed, {r('current_speed / free_flow_speed', 4)} as ratio from cur where free_flow_speed > 0
order by current_speed / free_flow_speed, location_name limit 5""")
def worst_roads(spark, path):
    return dashboard.worst_roads(current(spark, path)).select(
        "location_name", "current_speed", "free_flow_speed", rounded(F.col("ratio"), 4).alias("ratio"))


@query("w13_slowest_roads", f"""with {PREDICTIONS}, {_LATEST}, {_NEWEST}
select location_name, current_speed from cur order by current_speed, location_name limit 5""")
def slowest_roads(spark, path):
    return dashboard.slowest_roads(current(spark, path)).select("location_name", "current_speed")


_FEED = f"""{ANOMALIES}{ALERTS[ALERTS.index(", al as"):]}, fd as (
 select 'anomaly' as type, location_name as location, coalesce(nullif(reason, ''), 'Unusual traffic pattern detected') as message, detected_at as time,
   'anomaly' as severity, current_speed as speed, free_flow_speed as free_flow, anomaly_score as score from an where {ago('detected_at', 240)}
 union all select 'alert', location_name, message, triggered_at, split_part(alert_type, ':', 1), null, null, null from al where {ago('triggered_at', 240)})"""


def feed(spark, path):
    recent = dashboard.since("detected_at", t.as_of(), 240), dashboard.since("triggered_at", t.as_of(), 240)
    return dashboard.combined_feed(t.anomalies(spark, path).filter(recent[0]), t.alerts(spark, path).filter(recent[1]))


@query("w15_combined_feed", f"""with {_FEED} select type, location, message, {ts('time')} as time, severity, speed, free_flow, score,
  case when length(message) > 80 then concat(substring(message, 1, 80), '…') else message end as short from fd""")
def combined_feed(spark, path):
    return feed(spark, path).withColumn("short", texts.shortened(F.col("message")))


@query("w15_feed_counts", f"with {_FEED} select type, count(*) as count from fd group by 1")
def feed_counts(spark, path):
    return dashboard.feed_counts(feed(spark, path))


_ROADS = ["Road 01", "Road 07", "Road 20"]
_LEVELS = ["Free Flow", "Moderate", "Heavy", "Severe", "Closed"]


@query("a45_hourly_speed_pivot", f"with {SCORED} select hour, " + ", ".join(
    r(f"avg(current_speed) filter (where location_name = '{n}')", 1) + f' as "{n}"' for n in _ROADS)
    + f" from sc where {ago('request_time', 240)} and location_name in ('Road 01', 'Road 07', 'Road 20') group by 1")
def hourly_speed_pivot(spark, path):
    return dashboard.hourly_speed_pivot(t.readings(spark, path), _ROADS, t.as_of(), hours=240)


@query("a45_hourly_level_pivot", f"with {SCORED} select hour, " + ", ".join(
    f"count(*) filter (where congestion_level = '{n}') as \"{n}\"" for n in _LEVELS) + f" from sc where {ago('request_time', 240)} group by 1")
def hourly_level_pivot(spark, path):
    return dashboard.hourly_level_pivot(t.with_ratio(t.readings(spark, path)), t.as_of(), hours=240)
