"""Lags, forecast rows, buffers, alerts, cooldown, city snapshot and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.ingest import _HISTORY, feature_rows
from checks.sql import AS_OF, FORECASTS, SCORED, VERDICTS, r, rt, ts
from roadweave import fixed_values as fv
from roadweave.functions.geo import with_message_district
from roadweave.functions.numeric import rounded
from roadweave.models import metrics
from roadweave.plans import alerts, features, forecast, snapshot
from roadweave.streaming.windows import LATEST_COLUMNS, latest_records

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


_LAGS = ", ".join(f"lag({c}, {n}) over w as {p}_lag_{label}" for label, n in fv.LAG_ROWS.items()
                  for p, c in (("speed", "current_speed"), ("ratio", "congestion_ratio")))
_LAG_NAMES = [f"{p}_lag_{label}" for label in fv.LAG_ROWS for p in ("speed", "ratio")]
_WINDOW = "window w as (partition by location_name order by request_time, reading_id)"


def with_ratio4(spark, path):
    return t.with_ratio(t.plain_readings(spark, path)).withColumn("congestion_ratio", rounded(F.col("congestion_ratio"), 4))


@query("w02_lag_features", f"""with {SCORED}, s4 as (select reading_id, request_time, location_name, current_speed, {r('congestion_ratio', 4)} as congestion_ratio from sc),
 lg as (select reading_id, location_name, row_number() over w as position, {_LAGS} from s4 {_WINDOW})
select * from lg""")
def lag_features(spark, path):
    rows = with_ratio4(spark, path).select("reading_id", "request_time", "location_name", "current_speed", "congestion_ratio")
    return forecast.lag_features(rows).select("reading_id", "location_name", "position", *_LAG_NAMES)


@query("w03_trends", f"""with {SCORED}, s4 as (select reading_id, request_time, location_name, current_speed, {r('congestion_ratio', 4)} as congestion_ratio from sc),
 lg as (select *, {_LAGS} from s4 {_WINDOW})
select reading_id, {r('current_speed - speed_lag_30min', 2)} as speed_trend_30min, {r('congestion_ratio - ratio_lag_30min', 4)} as ratio_trend_30min,
  {r('ratio_lag_1hr - ratio_lag_10min', 4)} as congestion_buildup_1hr,
  {r('congestion_ratio - ratio_lag_30min - (ratio_lag_1hr - ratio_lag_30min)', 4)} as buildup_acceleration from lg""")
def trends(spark, path):
    rows = with_ratio4(spark, path).select("reading_id", "request_time", "location_name", "current_speed", "congestion_ratio")
    found = forecast.with_trends(forecast.lag_features(rows))
    return found.select("reading_id", *[rounded(F.col(c), n).alias(c) for c, n in (
        ("speed_trend_30min", 2), ("ratio_trend_30min", 4), ("congestion_buildup_1hr", 4), ("buildup_acceleration", 4))])


_FROUND = {"ratio": 4, "trend": 4, "speed_trend_30min": 2, "requested_lat": 6, "requested_lon": 6}


@query("w04_forecast_rows", f"""with {_HISTORY}, s4 as (select * replace ({r('congestion_ratio', 4)} as congestion_ratio) from hi),
 lg as (select *, row_number() over w as position, {_LAGS}, dense_rank() over (order by frc) - 1 as frc_encoded, dense_rank() over (order by district) - 1 as district_encoded,
   extract(isodow from request_time) - 1 as day_of_week from s4 {_WINDOW})
select reading_id, location_name, current_speed, free_flow_speed, congestion_ratio, {r('(1 - current_speed / free_flow_speed) * 100', 2)} as speed_drop_pct, delay_seconds,
  {', '.join(_LAG_NAMES)}, {r('current_speed - speed_lag_30min', 4)} as speed_trend_30min, {r('congestion_ratio - ratio_lag_30min', 4)} as ratio_trend_30min,
  {r('ratio_lag_1hr - ratio_lag_10min', 4)} as congestion_buildup_1hr, {r('congestion_ratio - ratio_lag_30min - (ratio_lag_1hr - ratio_lag_30min)', 4)} as buildup_acceleration,
  hour, day_of_week, cast(day_of_week in (4, 5) as bigint) as is_weekend,
  cast(day_of_week not in (4, 5) and hour in (7, 8, 9, 15, 16, 17, 18, 19) as bigint) as is_rush_hour, extract(month from request_time) as month,
  case when weather_temp = 0 then 25e0 else weather_temp end as temperature, cast(case when weather_humid = 0 then 40 else weather_humid end as bigint) as humidity,
  case when weather_wind = 0 then 3e0 else weather_wind end as wind_speed, weather_rain as rain_mm, cast(weather_rain > 0 as bigint) as is_raining,
  frc_encoded, district_encoded, requested_lat, requested_lon, confidence from lg where position > 144""")
def forecast_rows(spark, path):
    found = forecast_input(spark, path)
    trend = ["speed_trend_30min", "ratio_trend_30min", "congestion_buildup_1hr", "buildup_acceleration"]
    return found.withColumns({c: rounded(F.col(c), 4) for c in trend}).select("reading_id", "location_name", *fv.FORECAST_FEATURES)


def forecast_input(spark, path, extra=None, rows=None):
    """``rows``: the stored feature rows, where there are such."""
    plain = t.readings(spark, path)
    series = plain.select("location_name", F.col("request_time").alias("event_time"))
    return forecast.forecast_rows_from(
        feature_rows(spark, path) if rows is None else rows, features.class_index(plain, "frc"), district_index(plain), extra, series)


def district_index(readings):
    """Of each coordinate once: looking a district up costs more than finding the distinct coordinates."""
    return features.class_index(with_message_district(readings.select("requested_lat", "requested_lon").distinct()), "district")


@query("w05_recent_readings", f"""with {SCORED}, rk as (select *, row_number() over (partition by location_name order by request_time desc, reading_id desc) as recency
  from sc where request_time > {AS_OF} - interval 480 hours and current_speed is not null and free_flow_speed > 0)
select {ts('request_time')} as request_time, location_name, current_speed, free_flow_speed, {r('congestion_ratio', 4)} as congestion_ratio, road_closure,
  requested_lat, requested_lon from rk where recency <= 150""")
def recent_readings(spark, path):
    return forecast.buffer_records(forecast.recent_readings(t.plain_readings(spark, path), t.as_of(), hours=480))


@query("w06_active_roads", f"with {SCORED} select distinct location_name from sc where request_time > {AS_OF} - interval 168 hours")
def active_roads(spark, path):
    return forecast.active_roads(t.plain_readings(spark, path), t.as_of())


_READY = f"""{SCORED}, rb as (select location_name, least(150, count(*) filter (where request_time > {AS_OF} - interval 336 hours and free_flow_speed > 0)) as loaded
  from sc where request_time > {AS_OF} - interval 720 hours group by 1)
"""
_STATUS = "case when loaded = 0 then 'empty' when loaded >= 144 then 'warm' else 'partial' end"


@query("w07_buffer_readiness", f"with {_READY} select location_name, loaded, {_STATUS} as status from rb")
def buffer_readiness(spark, path):
    return forecast.buffer_readiness(t.plain_readings(spark, path), t.as_of(), days=30, hours=336)


@query("w07_readiness_totals", f"""with {_READY} select cast(sum(loaded) as bigint) as total_pushed, count(*) as roads, count(*) filter (where {_STATUS} = 'warm') as warm,
  count(*) filter (where {_STATUS} = 'partial') as partial, count(*) filter (where {_STATUS} = 'empty') as empty from rb""")
def readiness_totals(spark, path):
    return forecast.readiness_totals(forecast.buffer_readiness(t.plain_readings(spark, path), t.as_of(), days=30, hours=336))


@query("m06_forecast_table", f"""with {FORECASTS} select {ts('forecast_made_at')} as forecast_made_at, location_name, horizon, {ts('target_time')} as target_time,
  {r('predicted_speed', 1)} as predicted_speed, predicted_class, {r('confidence', 3)} as confidence from fc where horizon <> '30min'""")
def forecast_table(spark, path):
    """Per-road documents with one horizon missing, turned into rows."""
    entry = F.struct(rounded(F.col("predicted_speed"), 1).alias("speed"), F.col("predicted_class").alias("class"),
                     rounded(F.col("confidence"), 3).alias("confidence"))
    documents = (
        t.forecasts(spark, path)
        .groupBy("forecast_id", "location_name", F.col("forecast_made_at").alias("event_time"))
        .agg(F.map_from_entries(F.collect_list(F.struct("horizon", F.when(F.col("horizon") != "30min", entry)))).alias("forecasts"))
    )
    return forecast.forecast_table(documents)


# alerts ------------------------------------------------------------------------------

_SPEEDS = "concat('Speed ', cast(current_speed as varchar), ' km/h (free-flow ', cast(free_flow_speed as varchar), ' km/h)')"
_ROUND = "time_bucket(interval '1 hour', request_time)"
_RAISED = f"""{VERDICTS}, vr as (select *, {_ROUND} as round_start from vd),
 cl as (select distinct location_name, round_start from vr where road_closure),
 ct as (select round_start, max(request_time) as request_time, max(reading_id) as reading_id, count(*) as n,
   count(*) filter (where predicted_congestion = 'Moderate') as moderate, count(*) filter (where predicted_congestion = 'Heavy') as heavy,
   count(*) filter (where predicted_congestion = 'Severe') as severe, count(*) filter (where predicted_congestion = 'Closed') as closed,
   count(*) filter (where predicted_congestion <> 'Free Flow') * 1e2 / count(*) as pct from vr group by 1),
 ra as (
  select reading_id * 4 as alert_id, request_time as triggered_at, location_name, 'ANOMALY' as kind,
    case when anomaly_score < -0.05 then 'critical' when anomaly_score < 0 then 'warning' else 'info' end as severity,
    concat('Anomaly detected: ', coalesce(nullif(anomaly_reason, ''), 'unusual pattern'), '. Speed ', cast(current_speed as varchar), ' km/h vs ',
      cast(free_flow_speed as varchar), ' km/h free-flow. Score: ', cast(anomaly_score as varchar)) as message from vr where is_anomaly
  union all
  select reading_id * 4 + 1, request_time, location_name, case when predicted_congestion = 'Severe' then 'SEVERE_CONGESTION' else 'HEAVY_CONGESTION' end,
    case when predicted_congestion = 'Heavy' then 'info' when is_rush_hour = 1 then 'warning' else 'critical' end,
    case when predicted_congestion = 'Severe' and is_rush_hour = 1 then concat('Severe congestion during rush hour. ', {_SPEEDS})
      else concat(predicted_congestion, ' congestion outside rush hour. ', {_SPEEDS}, ' at hour ', hour) end
  from vr where predicted_congestion = 'Severe' or (predicted_congestion = 'Heavy' and is_rush_hour = 0)
  union all
  select reading_id * 4 + 2, request_time, location_name, 'ROAD_CLOSURE', 'warning',
    concat('Road closure detected. ', {_SPEEDS}, '. TomTom reports road_closure=true')
  from vr where road_closure and not exists (select 1 from cl where cl.location_name = vr.location_name and cl.round_start = vr.round_start - interval 1 hour)
  union all
  select reading_id * 4 + 3, request_time, 'Cairo (All Roads)', 'CITY_WIDE', case when pct > 60 then 'critical' else 'warning' end,
    concat({rt('pct', 0)}, '% of roads showing congestion or closure', case when pct > 60 then concat('. Moderate:', moderate, ' Heavy:', heavy, ' Severe:', severe, ' Closed:', closed) else '' end)
  from ct where pct > 40)"""
_ALERT = f"alert_id, {ts('triggered_at')} as triggered_at, location_name, kind, severity, concat(severity, ':', kind) as alert_type, message"


@query("r05_raised_alerts", f"with {_RAISED} select {_ALERT} from ra")
def raised_alerts(spark, path):
    return alerts.raised_alerts(t.scored(spark, path), 3600)


@query("w17_new_closures", f"""with {_RAISED} select reading_id, location_name, {ts('round_start')} as round_start from vr
where road_closure and not exists (select 1 from cl where cl.location_name = vr.location_name and cl.round_start = vr.round_start - interval 1 hour)""")
def new_closures(spark, path):
    rounds = alerts.with_round(t.readings(spark, path), 3600)
    return alerts.new_closures(rounds, 3600).select("reading_id", "location_name", "round_start")


@query("r04_city_rounds", f"""with {_RAISED} select {ts('round_start')} as round_start, n as roads, moderate as "Moderate", heavy as "Heavy", severe as "Severe", closed as "Closed",
  {r('pct', 2)} as pct from ct""")
def city_rounds(spark, path):
    found = alerts.city_rounds(alerts.with_round(t.scored(spark, path), 3600))
    return found.select("round_start", "roads", *fv.LEVELS[1:], rounded(F.col("pct"), 2).alias("pct"))


def _cooldown(hours: float) -> str:
    gap = f"interval {int(hours * 60)} minutes"
    return f"""with recursive {_RAISED}, ix as (select kind, location_name, triggered_at, min(alert_id) as alert_id from ra group by all),
 sent as (select kind, location_name, min(triggered_at) as triggered_at from ix group by all
  union all select s.kind, s.location_name, (select min(ix.triggered_at) from ix where ix.kind = s.kind and ix.location_name = s.location_name and ix.triggered_at >= s.triggered_at + {gap})
  from sent s where s.triggered_at is not null),
 fin as (select ra.* from ra join (select ix.alert_id from ix join sent using (kind, location_name, triggered_at)) k using (alert_id))"""


@query("t07_sent_alerts", f"{_cooldown(10 / 60)} select {_ALERT} from fin")
def sent_alerts(spark, path):
    return alerts.sent_alerts(t.scored(spark, path), 3600)


@query("t07_sent_alerts_long_cooldown", f"{_cooldown(30)} select {_ALERT} from fin")
def sent_alerts_long(spark, path):
    """Thirty hours of silence: longer than the blocks the time line is cut into."""
    return alerts.sent_alerts(t.scored(spark, path), 3600, cooldown_seconds=30 * 3600)


@query("r05_alert_statistics", f"""{_cooldown(6)}, ky as (select kind, location_name, count(*) as n, max(triggered_at) as last from fin group by 1, 2)
select cast(sum(n) as bigint) as total_alerts, count(*) filter (where epoch({AS_OF}) - floor(epoch(last)) <= 2 * 21600) as active_cooldowns from ky""")
def alert_statistics(spark, path):
    sent = alerts.sent_alerts(t.scored(spark, path), 3600, cooldown_seconds=6 * 3600)
    return alerts.alert_statistics(sent, t.as_of(), 6 * 3600)


# snapshot ----------------------------------------------------------------------------

_RECORDS = f"""{VERDICTS}, la as (select v.*, concat('District ', cast(user_id % 25 % 5 as varchar)) as district, f.first_seen from
  (select distinct on (location_name) * from vd order by location_name, request_time desc, reading_id desc) v
  join (select location_name, min(request_time) as first_seen from vd group by 1) f using (location_name)),
 wo as (select row_number() over (order by case congestion_level when 'Severe' then 0 when 'Closed' then 1 when 'Heavy' then 2 when 'Moderate' then 3 else 4 end,
   congestion_ratio, location_name) as rn, * from la),
 be as (select row_number() over (order by -congestion_ratio, location_name) as rn, * from la),
 fs as (select * from la order by first_seen, location_name limit 1),
 sn as (select (select {ts('request_time')} from fs) as timestamp, {r('avg(current_speed)', 1)} as city_avg_speed,
   {r("count(*) filter (where congestion_level = 'Heavy') * 1e2 / count(*)", 1)} as city_heavy_pct,
   {r("count(*) filter (where congestion_level = 'Severe') * 1e2 / count(*)", 1)} as city_severe_pct,
   {r("count(*) filter (where congestion_level = 'Closed') * 1e2 / count(*)", 1)} as city_closed_pct, count(*) as n_locations,
   (select to_json({{'main': weather_main, 'rain_mm': weather_rain, 'temperature': weather_temp}}) from fs) as weather,
   count(*) filter (where is_anomaly) as anomaly_count,
   coalesce((select to_json(list({{'name': location_name, 'district': district, 'speed': {r('current_speed', 1)}, 'class': congestion_level, 'trend_30min': {r('current_speed - free_flow_speed / 2', 1)}}} order by rn)) from wo
     where rn <= 4 and congestion_level in ('Severe', 'Heavy', 'Closed')), '[]') as top_hotspots,
   coalesce((select to_json(list({{'name': location_name, 'speed': {r('current_speed', 1)}, 'class': congestion_level}} order by rn)) from be
     where rn <= 2 and congestion_level = 'Free Flow'), '[]') as free_flowing from la)"""


def latest_state(spark, path):
    df = t.scored(spark, path).withColumns({
        "district": F.concat(F.lit("District "), (F.col("user_id") % 25 % 5).cast("string")),
        "rain_mm": F.col("weather_rain"), "temperature": F.col("weather_temp")})
    columns = [*LATEST_COLUMNS, "free_flow_speed"]
    # a stand-in for the trend of the last half hour
    return latest_records(df, ["request_time", "reading_id"], columns).withColumn(
        "trend_30min", F.col("current_speed") - F.col("free_flow_speed") / 2)


@query("a42_city_snapshot", f"with {_RECORDS} select * from sn")
def city_snapshot(spark, path):
    return snapshot.city_snapshot(latest_state(spark, path))


@query("a44_snapshot_key", f"""with {_RECORDS} select md5(concat('{{"anomaly_count":', anomaly_count, ',"city_avg_speed":', city_avg_speed, ',"city_closed_pct":', city_closed_pct,
  ',"city_heavy_pct":', city_heavy_pct, ',"city_severe_pct":', city_severe_pct, ',"free_flowing":', free_flowing, ',"n_locations":', n_locations,
  ',"timestamp":"', timestamp[1:10], 'T', timestamp[12:23], 'Z","top_hotspots":', top_hotspots, ',"weather":', weather, '}}')) as snapshot_key from sn""")
def snapshot_key(spark, path):
    return snapshot.with_snapshot_key(snapshot.city_snapshot(latest_state(spark, path))).select("snapshot_key")


@query("t11_latest_records", f"""with {_RECORDS} select location_name, district, current_speed, congestion_level, {r('congestion_ratio', 4)} as congestion_ratio,
  {ts('request_time')} as request_time, is_anomaly, {ts('first_seen')} as first_seen from la""")
def latest_records_table(spark, path):
    return latest_state(spark, path).select(
        "location_name", "district", "current_speed", "congestion_level", rounded(F.col("congestion_ratio"), 4).alias("congestion_ratio"),
        "request_time", "is_anomaly", "first_seen")


# metrics of the naive forecast (the speed an hour ago) ---------------------------------


@query("a43_regression_metrics", f"""with {FORECASTS}, jn as (select horizon, predicted_speed as p, current_speed as a from fc join sc on reading_id = forecast_id)
select horizon, count(*) as n, {r('avg(abs(p - a))', 4)} as mae, {r('sqrt(avg((p - a) * (p - a)))', 4)} as rmse,
  {r('1 - sum((p - a) * (p - a)) / (var_pop(a) * count(*))', 4)} as r2 from jn group by 1""")
def regression_metrics(spark, path):
    actual = t.readings(spark, path).select(F.col("reading_id").alias("forecast_id"), "current_speed")
    return metrics.regression_metrics(t.forecasts(spark, path).join(actual, "forecast_id"), "current_speed", "predicted_speed", ["horizon"])


@query("a43_classification_metrics", f"""with {FORECASTS[:FORECASTS.index(', lg as')]}, pr as (select congestion_level as a,
   coalesce(lag(congestion_level) over (partition by location_name order by request_time, reading_id), 'Free Flow') as p from sc),
 cl as (select v.level, (select count(*) from pr where a = v.level) as na, (select count(*) from pr where p = v.level) as np, (select count(*) from pr where a = v.level and p = v.level) as hit
   from (values ('Free Flow'), ('Moderate'), ('Heavy'), ('Severe'), ('Closed')) v(level)),
 f1 as (select *, 2e0 * hit / (na + np) as f from cl where na + np > 0)
select cast(sum(na) as bigint) as n, {r('sum(hit) * 1e0 / sum(na)', 4)} as accuracy, {r('sum(f * na) / sum(na)', 4)} as f1_weighted, {r('avg(f)', 4)} as f1_macro from f1""")
def classification_metrics(spark, path):
    return metrics.classification_metrics(t.predictions(spark, path), "actual_congestion", "predicted_congestion")
