"""Text helpers for the DuckDB side of the checks."""

from __future__ import annotations

from roadweave import fixed_values as fv


def r(x: str, n: int) -> str:
    return f"cast(cast(cast({x} as decimal(18,6)) as decimal(18,{n})) as double)"


def ri(x: str) -> str:
    return f"cast(cast(cast({x} as decimal(18,6)) as decimal(18,0)) as bigint)"


def rt(x: str, n: int) -> str:
    return f"cast(cast(cast({x} as decimal(18,6)) as decimal(18,{n})) as varchar)"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def pct(condition: str, n: int = 1) -> str:
    return r(f"count(*) filter (where {condition}) * 1e2 / count(*)", n)


def level(ratio: str, closed: str) -> str:
    return (f"case when {closed} then 'Closed' when {ratio} >= 0.75 then 'Free Flow' when {ratio} >= 0.50 then 'Moderate' "
            f"when {ratio} >= 0.25 then 'Heavy' else 'Severe' end")


def eda_level(ratio: str) -> str:
    return (f"case when {ratio} is null then 'Unknown' when {ratio} >= 0.8 then 'Free Flow' when {ratio} >= 0.6 then 'Light' "
            f"when {ratio} >= 0.4 then 'Moderate' when {ratio} >= 0.2 then 'Heavy' else 'Severe' end")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def named(value: str, table: dict, default: str = "'Unknown'") -> str:
    """Code lookup as a CASE over a fixed table."""
    whens = " ".join(f"when {quoted(k) if isinstance(k, str) else k} then {quoted(v) if isinstance(v, str) else v}"
                     for k, v in table.items())
    return f"case {value} {whens} else {default} end"


RUSH = "(hour between 7 and 9 or hour between 16 and 19)"
AS_OF = "timestamp '2024-01-31 00:00:00'"

READINGS = """rd as (
  select event_id as reading_id, ts as request_time,
    concat('Road ', lpad(cast(user_id % 25 as varchar), 2, '0')) as location_name,
    2.99e1 + (user_id % 25) * 1.2e-2 as requested_lat,
    3.11e1 + ((user_id * 7) % 25) * 1.3e-2 as requested_lon,
    concat('FRC', cast(user_id % 6 as varchar)) as frc,
    value as current_speed, cast(40 + 3 * (user_id % 25) as double) as free_flow_speed,
    cast(50 + (event_id * 7) % 400 as int) as current_travel_time,
    cast(60 + event_id % 120 as int) as free_flow_travel_time,
    cast(event_id % 101 as double) / 1e2 as confidence, event_id % 97 = 0 as road_closure,
    cast(event_id % 450 as double) / 1e1 as weather_temp, cast(event_id % 101 as int) as weather_humid,
    cast(event_id % 23 as double) / 2e0 as weather_wind,
    case when event_id % 10 = 0 then cast(event_id % 70 as double) / 1e1 else 0e0 end as weather_rain,
    case event_type when 'click' then 'Clear' when 'view' then 'Clouds' when 'purchase' then 'Rain'
      when 'error' then 'Dust' else 'Fog' end as weather_main,
    event_type, user_id
  from events)"""

SCORED = f"""{READINGS}, rr as (
  select *, case when free_flow_speed > 0 then current_speed / free_flow_speed else 0e0 end as congestion_ratio,
    extract(hour from request_time) as hour from rd),
 sc as (select *, {level('congestion_ratio', 'road_closure')} as congestion_level from rr)"""

WEATHER_ROWS = ", ".join("(" + ", ".join([str(i), *map(quoted, w)]) + ")" for i, w in enumerate(fv.SEED_WEATHER, 1))

STAGING = f"""{SCORED}, dw(weather_key, condition, temp_range, rain_level, visibility_impact) as (values {WEATHER_ROWS}),
 stg as (select request_time as event_time, current_speed, free_flow_speed, congestion_ratio, road_closure, confidence,
    weather_temp as temperature, weather_rain as rain_mm, weather_humid as humidity, weather_wind as wind_speed,
    location_name, concat('District ', cast(user_id % 25 % 5 as varchar)) as district,
    case user_id % 25 % 4 when 0 then 'Highway' when 1 then 'Main Road' when 2 then 'Bridge' else 'Corniche' end as road_class,
    2.99e1 + (user_id % 25) * 1.2e-2 as lat, 3.11e1 + ((user_id % 25 * 7) % 25) * 1.3e-2 as lon,
    cast(hour as int) as hour, cast(extract(dow from request_time) as int) as day_of_week, dayname(request_time) as day_name,
    extract(dow from request_time) in (5, 6) as is_weekend, {RUSH} as is_rush_hour,
    case when hour <= 5 then 'Late Night' when hour = 6 then 'Early Morning' when hour <= 9 then 'Morning Rush'
      when hour <= 15 then 'Midday' when hour <= 19 then 'Evening Rush' else 'Night' end as time_period,
    weather_main as weather_condition, temp_range, rain_level, visibility_impact, congestion_level, weather_key,
    user_id, reading_id
  from sc left join dw on weather_main = condition)"""


def mode_of(table: str, keys: str, value: str, name: str) -> str:
    """CTE ``name(keys, value)``: most frequent value per group, ties to the smallest."""
    return (f"{name} as (select {keys}, {value} as top_value from (select {keys}, {value}, row_number() over "
            f"(partition by {keys} order by count(*) desc, {value}) as rn from {table} where {value} is not null "
            f"group by {keys}, {value}) where rn = 1)")


EXPLORE = f"""{READINGS}, ex as (
  select reading_id, request_time, location_name, requested_lat, requested_lon, frc, current_speed, free_flow_speed,
    current_travel_time, free_flow_travel_time, confidence, road_closure,
    cast(extract(hour from request_time) as bigint) as hour, cast(extract(minute from request_time) as bigint) as minute,
    dayname(request_time) as day_of_week, cast(request_time as date) as date,
    {r('current_speed / free_flow_speed', 4)} as congestion_ratio,
    {r('(free_flow_speed - current_speed) * 100 / free_flow_speed', 2)} as speed_drop_pct,
    cast(current_travel_time - free_flow_travel_time as bigint) as delay_seconds,
    case when extract(hour from request_time) between 7 and 9 or extract(hour from request_time) between 16 and 19
      then 'Rush hour' else 'Off-peak' end as is_rush_hour,
    {named('frc', fv.ROAD_TYPES)} as road_type
  from rd),
 el as (select *, {eda_level('congestion_ratio')} as congestion_level from ex)"""

# readings with the defects the quality checks look for, times as text
MESSAGES = f"""{READINGS}, ms as (
  select reading_id, reading_id as event_id, request_time + to_minutes(reading_id % 20) as arrived_at,
    case when reading_id % 179 = 0 then 'not-a-time' when reading_id % 173 = 0 then ''
      else strftime(request_time, '%Y-%m-%d %H:%M:%S') end as request_time,
    case when reading_id % 211 = 0 then null when reading_id % 223 = 0 then '' else location_name end as location_name,
    case when reading_id % 199 = 0 then null when reading_id % 151 = 0 then requested_lat + 1 else requested_lat end as requested_lat,
    requested_lon, frc,
    case when reading_id % 193 = 0 then null when reading_id % 191 = 0 then -current_speed else current_speed end as current_speed,
    case when reading_id % 181 = 0 then 0e0 when reading_id % 183 = 0 then null else free_flow_speed end as free_flow_speed,
    current_travel_time, free_flow_travel_time, confidence, road_closure,
    case when reading_id % 167 = 0 then weather_temp + 100 else weather_temp end as weather_temp,
    case when reading_id % 163 = 0 then -5 else weather_humid end as weather_humid, weather_wind,
    case when reading_id % 157 = 0 then -1.5e0 else weather_rain end as weather_rain, weather_main
  from rd)"""

_S = "cast({} as varchar)"
_CHECKS = [
    ("speed_sanity", "fatal", "current_speed is null", "'current_speed is null'"),
    ("speed_sanity", "critical", "current_speed < 0", "'negative speed: ' || cast(current_speed as varchar) || ' km/h'"),
    ("speed_sanity", "critical", "current_speed > 200",
     "'unrealistic speed: ' || cast(current_speed as varchar) || ' km/h (max expected: 200)'"),
    ("free_flow_sanity", "critical", "free_flow_speed is null or free_flow_speed <= 0",
     "'invalid free_flow_speed: ' || coalesce(cast(free_flow_speed as varchar), 'None')"),
    ("closure_consistency", "warning",
     "road_closure and current_speed <> 0 and free_flow_speed > 0 and current_speed / free_flow_speed >= 0.80",
     "'closure flag set but traffic flowing (speed=' || cast(current_speed as varchar) || ' = ' || "
     + rt("current_speed / free_flow_speed * 100", 0) + " || '% of free-flow ' || cast(free_flow_speed as varchar) || ')'"),
    ("coordinates", "critical", "not (requested_lat between 29.85 and 30.20)",
     "'latitude ' || cast(requested_lat as varchar) || ' outside Cairo bounds (29.85-30.2)'"),
    ("coordinates", "critical", "not (requested_lon between 31.05 and 31.45)",
     "'longitude ' || cast(requested_lon as varchar) || ' outside Cairo bounds (31.05-31.45)'"),
    ("freshness", "warning", "age > 10", "'reading is ' || " + rt("age", 0) + " || ' min old (threshold: 10 min)'"),
    ("freshness", "info", "request_time <> '' and age is null", "'could not parse timestamp: ' || request_time"),
    ("weather_sanity", "warning", "weather_temp < -10 or weather_temp > 60",
     "'unrealistic temperature: ' || cast(weather_temp as varchar) || '°C'"),
    ("weather_sanity", "info", "weather_humid < 0 or weather_humid > 100",
     "'humidity out of range: ' || cast(weather_humid as varchar) || '%'"),
    ("weather_sanity", "info", "weather_rain < 0", "'negative rain value: ' || cast(weather_rain as varchar) || ' mm'"),
]
_FIRST = [
    ("required_fields", "fatal", "coalesce(location_name, '') = ''", "'missing location_name'"),
    ("required_fields", "fatal", "requested_lat is null or requested_lon is null", "'missing lat/lon coordinates'"),
]


def _issue(check) -> str:
    name, severity, test, message = check
    return f"case when {test} then {{'check': '{name}', 'severity': '{severity}', 'message': {message}}} end"


def _issues(checks) -> str:
    return "[x for x in [" + ", ".join(map(_issue, checks)) + "] if x is not null]"


QUALITY = f"""{MESSAGES}, ag as (
  select *, (epoch_us(arrived_at) - epoch_us(try_cast(nullif(request_time, '') as timestamp))) / 6e7 as age,
    coalesce(location_name, '') = '' or requested_lat is null or requested_lon is null as unusable from ms),
 iq as (select *, case when unusable then {_issues(_FIRST)} else {_issues(_CHECKS)} end as issues from ag),
 sq as (select *, len(issues) as issues_count,
    greatest(0, 100 - coalesce(list_sum([case i.severity when 'fatal' then 50 when 'critical' then 30
      when 'warning' then 15 else 5 end for i in issues]), 0)) as quality_score,
    len([i for i in issues if i.severity = 'fatal']) > 0 as fatal from iq),
 ql as (select *, not fatal and quality_score >= 50 as passed, arrived_at as checked_at from sq)"""

PREDICTIONS = f"""{SCORED}, pr as (
  select reading_id as prediction_id, request_time as predicted_at, location_name,
    coalesce(lag(congestion_level) over (partition by location_name order by request_time, reading_id), 'Free Flow') as predicted_congestion,
    congestion_level as actual_congestion, confidence, concat('reason ', user_id) as top_reason_1,
    '' as top_reason_2, '' as top_reason_3 from sc)"""

ANOMALY_REASON = ("coalesce(nullif(concat_ws('; ', case when road_closure then 'road closure detected' end, "
                  "case when speed_drop_pct > 30 then concat('speed ', " + rt("speed_drop_pct", 0) + ", '% below free-flow') end, "
                  "case when speed_deviation < -10 then concat('speed ', " + rt("abs(speed_deviation)", 1)
                  + ", 'km/h below road average') end, "
                  "case when weather_rain > 5 then concat('heavy rain (', cast(weather_rain as varchar), 'mm)') end), ''), "
                  "concat('strong anomaly signal (score=', " + rt("anomaly_score", 4) + ", ')'))")

VERDICTS = f"""{SCORED}, v0 as (
  select *, congestion_level as predicted_congestion, event_type = 'error' as is_anomaly,
    {r("cast(reading_id * 37 % 400 as double) / 1e3 - 3e-1", 4)} as anomaly_score,
    case when {RUSH} then 1 else 0 end as is_rush_hour, (1 - congestion_ratio) * 100 as speed_drop_pct,
    current_speed - 50 as speed_deviation from sc),
 vd as (select *, case when is_anomaly then {ANOMALY_REASON} end as anomaly_reason from v0)"""

ANOMALIES = f"""{VERDICTS}, an as (
  select reading_id as anomaly_id, request_time as detected_at, location_name, anomaly_score, current_speed, free_flow_speed,
    {r('congestion_ratio', 4)} as congestion_ratio, anomaly_reason as reason from vd where is_anomaly)"""

ALERTS = f"""{READINGS}, al as (
  select reading_id as alert_id, request_time as triggered_at, location_name,
    case when event_type = 'error' then 'critical:ANOMALY' else 'warning:ROAD_CLOSURE' end as alert_type,
    concat('Reading ', reading_id, ' on ', location_name, ' was measured at ', cast(current_speed as varchar),
      ' km/h and has been reported to the control room') as message, true as delivered
  from rd where event_type in ('error', 'purchase'))"""

INCIDENTS = f"""inc as (
  select reading_id as row_id, request_time as fetched_at, user_id as incident_id, cast(reading_id % 15 as int) as icon_category,
    {named('reading_id % 15', fv.INCIDENT_TYPES)} as incident_type,
    cast(reading_id % 600 - 30 as double) as delay_seconds,
    requested_lat + reading_id % 4 * 6e-4 as lat, requested_lon - reading_id % 4 * 4e-4 as lon
  from rd where event_type = 'error')"""

WEATHER = f"""{READINGS}, we as (
  select reading_id as weather_id, request_time as recorded_at, weather_temp as temperature, weather_temp - 1 as feels_like,
    weather_humid as humidity, weather_main, lower(weather_main) as weather_desc, weather_wind as wind_speed,
    weather_rain as rain_mm from rd where event_type = 'view')"""

FORECASTS = f"""{SCORED}, lg as (select *,
    lag(current_speed, 1) over w as l20, lag(current_speed, 3) over w as l30, lag(current_speed, 6) over w as l60 from sc
    window w as (partition by location_name order by request_time, reading_id)),
 fc as (select reading_id as forecast_id, request_time as forecast_made_at, location_name, h.horizon,
    request_time + to_minutes(h.mins) as target_time, h.speed as predicted_speed, congestion_level as predicted_class, confidence
  from lg, lateral (values ('20min', 20, l20), ('30min', 30, l30), ('60min', 60, l60)) h(horizon, mins, speed)
  where h.speed is not null)"""

WINDOWS = f"""{READINGS}, win as (
  select time_bucket(interval '5 minutes', request_time) as window_start,
    time_bucket(interval '5 minutes', request_time) + interval '5 minutes' as window_end, location_name,
    {r('avg(current_speed)', 2)} as avg_speed, {r('min(current_speed)', 2)} as min_speed, {r('max(current_speed)', 2)} as max_speed,
    {r('coalesce(avg(free_flow_speed), 0)', 2)} as avg_free_flow_speed,
    {r('case when avg(free_flow_speed) > 0 then avg(current_speed) / avg(free_flow_speed) else 0e0 end', 4)} as avg_congestion_ratio,
    count(*) as reading_count, count(*) filter (where road_closure) as closure_count
  from rd group by 1, 2, 3 having count(current_speed) > 0)"""

SUMMARIES = f"""{READINGS}, su as (
  select max(request_time) as generated_at, concat('Top speed ', cast(max(current_speed) as varchar), ' km/h') as summary_text,
    '{{}}' as snapshot_data, count(*) as tokens_in, extract(day from cast(request_time as date)) * 3 as tokens_out,
    extract(day from cast(request_time as date)) * 100 as elapsed_ms, false as cached,
    case extract(day from cast(request_time as date)) % 3 when 0 then 'quota exceeded' when 1 then '' end as error
  from rd group by cast(request_time as date))"""

BOXES = "case " + " ".join(
    f"when {{lat}} between {s!r}e0 and {n!r}e0 and {{lon}} between {w!r}e0 and {e!r}e0 then {quoted(name)}"
    for name, s, n, w, e in fv.DISTRICT_BOXES) + " end"
POINTS = ", ".join(f"({i}, {lat!r}e0, {lon!r}e0, {quoted(d)})" for i, (_, lat, lon, d) in enumerate(fv.KNOWN_POINTS))


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2 * 6371e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


# district of every distinct coordinate pair of ``rd``, with the nearest known point
DISTRICTS = f"""kp(pos, plat, plon, pdistrict) as (values {POINTS}),
 co as (select distinct requested_lat as lat, requested_lon as lon from rd where requested_lat is not null and requested_lon is not null),
 nn as (select lat, lon, pdistrict as nearest, km from (select *, row_number() over (partition by lat, lon order by km, pos) as rn
   from (select lat, lon, pos, pdistrict, {haversine('lat', 'lon', 'plat', 'plon')} as km from co, kp)) where rn = 1),
 ds as (select lat, lon, nearest, km, {BOXES.format(lat='lat', lon='lon')} as box,
    case when lat between 29.5 and 30.5 and lon between 30.5 and 32.0
      then coalesce({BOXES.format(lat='lat', lon='lon')}, nearest) else nearest end as place from nn)"""
