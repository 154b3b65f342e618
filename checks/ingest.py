"""Parsing, features, geography and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.sql import (DISTRICTS, MESSAGES, READINGS, SCORED, VERDICTS, WEATHER, ANOMALY_REASON, haversine, named, quoted, r, ri, rt, ts)
from roadweave import fixed_values as fv
from roadweave.functions import geo, lookups, texts
from roadweave.functions.numeric import rounded
from roadweave.models import isolation_forest
from roadweave.operators import places
from roadweave.operators.asof import asof_join
from roadweave.plans import features, stats
from roadweave.session import checkpoint_dir
from roadweave.sources import messages, payloads
from roadweave.sources.dimensions import insert_if_absent

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


@query("s02_message_round_trip", f"""with {READINGS}
select {ts('request_time')} as request_time, requested_lat, requested_lon, location_name, frc, current_speed, free_flow_speed,
  cast(current_travel_time as bigint) as current_travel_time, cast(free_flow_travel_time as bigint) as free_flow_travel_time,
  confidence, road_closure, weather_temp, cast(weather_humid as bigint) as weather_humid, weather_wind, weather_rain, weather_main
from rd""")
def message_round_trip(spark, path):
    sent = t.plain_readings(spark, path)
    place = F.col("location_name")
    body = sent.drop("reading_id").withColumn(
        "request_time", F.date_format("request_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return messages.parse_messages(messages.as_messages(body, place))


@query("p01_flow_payload", f"""with {READINGS}
select reading_id, frc, current_speed, free_flow_speed, cast(current_travel_time as bigint) as current_travel_time,
  cast(free_flow_travel_time as bigint) as free_flow_travel_time, confidence,
  case when reading_id % 7 = 0 then false else road_closure end as road_closure from rd""")
def flow_payload(spark, path):
    flow = F.struct(
        "frc", F.col("current_speed").alias("currentSpeed"), F.col("free_flow_speed").alias("freeFlowSpeed"),
        F.col("current_travel_time").alias("currentTravelTime"),
        F.col("free_flow_travel_time").alias("freeFlowTravelTime"), "confidence",
        # left out of the document for some readings: the default must apply
        F.when(F.col("reading_id") % 7 != 0, F.col("road_closure")).alias("roadClosure"))
    raw = t.readings(spark, path).select(
        "reading_id", F.to_json(F.struct(flow.alias("flowSegmentData"))).alias("payload"))
    return payloads.parse_flow(raw).drop("raw_payload")


@query("p02_weather_payload", f"""with {READINGS}
select reading_id, weather_temp as temperature, weather_temp - 1 as feels_like, cast(weather_humid as bigint) as humidity,
  weather_main, lower(weather_main) as weather_desc, weather_wind as wind_speed, weather_rain as rain_mm from rd""")
def weather_payload(spark, path):
    document = F.struct(
        F.struct(F.col("weather_temp").alias("temp"), (F.col("weather_temp") - 1).alias("feels_like"),
                 F.col("weather_humid").alias("humidity")).alias("main"),
        F.array(F.struct(F.col("weather_main").alias("main"), F.lower("weather_main").alias("description"))).alias("weather"),
        F.struct(F.col("weather_wind").alias("speed")).alias("wind"),
        F.when(F.col("weather_rain") > 0, F.struct(F.col("weather_rain").alias("1h"))).alias("rain"))
    raw = t.readings(spark, path).select("reading_id", F.to_json(document).alias("payload"))
    return payloads.parse_weather(raw).drop("raw_payload")


@query("p03_incident_payload", f"""with {READINGS}
select reading_id, concat('inc-', reading_id) as incident_id, {named('reading_id % 15', fv.INCIDENT_TYPES)} as incident_type,
  reading_id % 15 as icon_category, {named('reading_id % 6', fv.DELAY_MAGNITUDES)} as magnitude,
  case when reading_id % 3 = 0 then 'No description' when reading_id % 3 = 1 then event_type else concat(event_type, '; ', weather_main) end as description,
  location_name as road_from, '' as road_to, case when reading_id % 2 = 0 then concat(frc, ', R1') else '' end as road_numbers,
  cast(reading_id % 600 as double) as delay_seconds, 0e0 as length_meters,
  case when reading_id % 5 = 4 then null when reading_id % 5 in (1, 2) then requested_lat + 1 else requested_lat end as lat,
  case when reading_id % 5 = 4 then null when reading_id % 5 in (1, 2) then requested_lon + 1 else requested_lon end as lon
from rd""")
def incident_payload(spark, path):
    """Five shapes in turn: point, line of two, line of three, line of one, no coordinates."""
    lon, lat = F.col("requested_lon").cast("string"), F.col("requested_lat").cast("string")
    lon1, lat1 = (F.col("requested_lon") + 1).cast("string"), (F.col("requested_lat") + 1).cast("string")
    shape = F.col("reading_id") % 5
    coordinates = (
        F.when(shape == 0, F.concat(F.lit("["), lon, F.lit(","), lat, F.lit("]")))
        .when(shape == 1, F.concat(F.lit("[[0,0],["), lon1, F.lit(","), lat1, F.lit("]]")))
        .when(shape == 2, F.concat(F.lit("[[0,0],["), lon1, F.lit(","), lat1, F.lit("],[5,5]]")))
        .when(shape == 3, F.concat(F.lit("[["), lon, F.lit(","), lat, F.lit("]]")))
        .otherwise(F.lit("[]")))
    kind = F.when(shape == 0, F.lit("Point")).otherwise(F.lit("LineString"))
    said = F.col("reading_id") % 3
    events = (
        F.when(said == 0, F.lit('[{"description":"","code":1}]'))
        .when(said == 1, F.concat(F.lit('[{"description":"'), F.col("event_type"), F.lit('"},{"code":2}]')))
        .otherwise(F.concat(F.lit('[{"description":"'), F.col("event_type"), F.lit('"},{"description":"'),
                            F.col("weather_main"), F.lit('"}]'))))
    numbers = F.when(F.col("reading_id") % 2 == 0, F.concat(F.lit('["'), F.col("frc"), F.lit('","R1"]'))).otherwise(F.lit("[]"))
    document = F.concat(
        F.lit('{"incidents":[{"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates,
        F.lit('},"properties":{"id":"inc-'), F.col("reading_id").cast("string"),
        F.lit('","iconCategory":'), (F.col("reading_id") % 15).cast("string"),
        F.lit(',"magnitudeOfDelay":'), (F.col("reading_id") % 6).cast("string"),
        F.lit(',"delay":'), (F.col("reading_id") % 600).cast("string"),
        F.lit(',"from":"'), F.col("location_name"), F.lit('","events":'), events,
        F.lit(',"roadNumbers":'), numbers, F.lit("}}]}"))
    raw = t.readings(spark, path).select("reading_id", document.alias("payload"))
    return payloads.explode_incidents(raw).drop("raw_geometry", "start_time", "end_time")


@query("s14_insert_if_absent", """select distinct user_id, true as known from events""")
def absent_users(spark, path):
    """Users seen on the first day, completed by those seen later."""
    users = t.readings(spark, path)
    early = users.filter(F.col("request_time") < F.lit("2024-01-02").cast("timestamp")).select("user_id").distinct()
    late = users.select("user_id")
    return insert_if_absent(early, late, ["user_id"]).withColumn("known", F.lit(True))


_FRESH = "case when rd.request_time - w.recorded_at <= interval 30 minutes then w.{} end"


@query("p06_readings_with_weather", f"""with {WEATHER}
select rd.reading_id, {ts('rd.request_time')} as request_time, {_FRESH.format('temperature')} as temperature,
  {_FRESH.format('weather_main')} as condition, {_FRESH.format('rain_mm')} as rain_mm
from rd asof left join we w on rd.request_time >= w.recorded_at""")
def readings_with_weather(spark, path):
    left = t.readings(spark, path).select("reading_id", "request_time")
    right = t.weather(spark, path).withColumnRenamed("weather_main", "condition")
    return asof_join(left, right, "request_time", "reading_id", "recorded_at", "weather_id",
                     ["temperature", "condition", "rain_mm"], tolerance_seconds=1800)


_STATS = """avg(current_speed) as avg_speed, avg(free_flow_speed) as avg_free_flow_speed, avg(congestion_ratio) as avg_congestion_ratio,
  avg(delay_seconds) as avg_delay_seconds, count(*) as sample_count"""
_HISTORY = f"""{SCORED}, {DISTRICTS}, hi as (select sc.*, ds.place as district, greatest(0, current_travel_time - free_flow_travel_time) as delay_seconds
  from sc join ds on ds.lat = requested_lat and ds.lon = requested_lon),
 st as (select 'city' as level, '' as key, {_STATS} from hi
  union all select 'district', district, {_STATS} from hi group by district
  union all select 'location', location_name, {_STATS} from hi group by location_name),
 fi as (select location_name, district, requested_lat, requested_lon, frc from (select *, row_number() over (partition by location_name
   order by request_time, reading_id) as rn from hi) where rn = 1)"""


def history(spark, path):
    df = t.with_ratio(t.plain_readings(spark, path))
    return df.withColumn("delay_seconds", F.greatest(F.lit(0), F.col("current_travel_time") - F.col("free_flow_travel_time")))


def statistics(spark, path):
    """The statistics are a small document looked up many times, so they are computed once."""
    checkpoint_dir(spark)
    return stats.location_statistics(history(spark, path), ["request_time", "reading_id"]).checkpoint()


@query("a10_location_statistics", f"""with {_HISTORY}
select level, key, {r('avg_speed', 4)} as avg_speed, {r('avg_free_flow_speed', 4)} as avg_free_flow_speed,
  {r('avg_congestion_ratio', 4)} as avg_congestion_ratio, {r('avg_delay_seconds', 4)} as avg_delay_seconds, sample_count,
  case when level = 'location' then fi.district end as district, case when level = 'location' then requested_lat end as lat,
  case when level = 'location' then requested_lon end as lon, case when level = 'location' then frc end as frc
from st left join fi on level = 'location' and key = location_name""")
def location_statistics(spark, path):
    found = statistics(spark, path)
    return found.withColumns({m: rounded(F.col(m), 4) for m in stats.MEASURES})


# every third reading comes from a road the document does not know, some of those without coordinates
_PLACED = """case when user_id % 3 = 0 then concat('New road ', user_id) else hi.location_name end"""


def _partly_unknown(spark, path):
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("New road "), F.col("user_id").cast("string"))).otherwise(F.col("location_name"))
    lat = F.when(F.col("user_id") % 6 == 0, F.lit(None).cast("double")).otherwise(F.col("requested_lat"))
    return t.readings(spark, path).withColumns({"location_name": name, "requested_lat": lat})


@query("p22_location_stats_lookup", f"""with {_HISTORY}
select reading_id, {_PLACED} as location_name,
  {r('coalesce(case when user_id % 3 <> 0 then l.avg_speed end, case when user_id % 6 <> 0 then d.avg_speed end, c.avg_speed)', 4)} as avg_speed,
  {r('coalesce(case when user_id % 3 <> 0 then l.avg_congestion_ratio end, case when user_id % 6 <> 0 then d.avg_congestion_ratio end, c.avg_congestion_ratio)', 4)} as avg_congestion_ratio,
  case when user_id % 3 <> 0 then fi.district when user_id % 6 <> 0 then hi.district else 'Unknown' end as district,
  case when user_id % 3 <> 0 then 'location' when user_id % 6 <> 0 then 'district' else 'city_wide' end as source
from hi join st l on l.level = 'location' and l.key = hi.location_name join fi on fi.location_name = hi.location_name
  join st d on d.level = 'district' and d.key = hi.district join st c on c.level = 'city'""")
def location_stats_lookup(spark, path):
    rows = stats.with_location_stats(_partly_unknown(spark, path), statistics(spark, path))
    return rows.select(
        "reading_id", "location_name", rounded(F.col("stats.avg_speed"), 4).alias("avg_speed"),
        rounded(F.col("stats.avg_congestion_ratio"), 4).alias("avg_congestion_ratio"), "stats.district", "stats.source")


@query("p24_store_summary", f"""with {_HISTORY}
select count(*) filter (where level = 'location') as n_locations, count(*) filter (where level = 'district') as n_districts,
  {r("max(case when level = 'city' then avg_speed end)", 4)} as city_avg_speed from st""")
def store_summary(spark, path):
    return stats.store_summary(statistics(spark, path))


@query("p08_traffic_features", f"""with {_HISTORY}, ft as (select hi.*, l.avg_speed as la, l.avg_congestion_ratio as lr, d.avg_congestion_ratio as dt,
    dense_rank() over (order by frc) - 1 as fe, extract(isodow from request_time) - 1 as dw
  from hi join st l on l.level = 'location' and l.key = hi.location_name join st d on d.level = 'district' and d.key = hi.district)
select reading_id, current_speed, free_flow_speed, {r('congestion_ratio', 4)} as congestion_ratio,
  {r('(1 - congestion_ratio) * 100', 2)} as speed_drop_pct, delay_seconds, {r('current_speed - la', 2)} as speed_deviation,
  hour, dw as day_of_week, cast(dw in (4, 5) as bigint) as is_weekend,
  cast((hour between 7 and 9 or hour between 16 and 19) as bigint) as is_rush_hour,
  cast(case when hour <= 5 then 0 when hour <= 9 then 1 when hour <= 14 then 2 when hour <= 19 then 3 else 4 end as bigint) as time_period,
  extract(month from request_time) as month, case when weather_temp = 0 then 25e0 else weather_temp end as temperature,
  cast(case when weather_humid = 0 then 40 else weather_humid end as bigint) as humidity,
  case when weather_wind = 0 then 3e0 else weather_wind end as wind_speed, weather_rain as rain_mm,
  cast(weather_rain > 0 as bigint) as is_raining, fe as frc_encoded, {r('dt', 4)} as district_target_encoded,
  {r('la', 2)} as loc_avg_speed, {r('lr', 4)} as loc_avg_congestion, cast(free_flow_speed < 25 as bigint) as is_slow_road, confidence,
  district, cast(road_closure as bigint) as road_closure_int
from ft""")
def traffic_features(spark, path):
    return feature_rows(spark, path).select(
        "reading_id", *fv.CONGESTION_FEATURES, "district", "road_closure_int")


def feature_rows(spark, path, stats=None):
    readings = t.spread_readings(spark, path).drop("event_type", "user_id")
    stats = statistics(spark, path) if stats is None else stats
    return features.traffic_features(readings, stats, features.class_index(t.plain_readings(spark, path), "frc"), t.as_of())


@query("p21_district_lookup", f"""with {READINGS}, {DISTRICTS}
select reading_id, box as box_district, nearest as nearest_district, {r('km', 3)} as nearest_km, place as district,
  {r(haversine('requested_lat', 'requested_lon', '30.0444e0', '31.2357e0'), 4)} as km_to_centre
from rd join ds on lat = requested_lat and lon = requested_lon""")
def district_lookup(spark, path):
    lat, lon = F.col("requested_lat"), F.col("requested_lon")
    rows = geo.with_district(geo.with_nearest_point(t.readings(spark, path), "requested_lat", "requested_lon"))
    nearest = F.col("nearest")
    return rows.select(
        "reading_id", geo.district_by_box("requested_lat", "requested_lon").alias("box_district"),
        geo.point_value(nearest, 3).alias("nearest_district"),
        rounded(geo.haversine_km(lat, lon, geo.point_value(nearest, 1), geo.point_value(nearest, 2)), 3).alias("nearest_km"),
        "district", rounded(geo.haversine_km(lat, lon, F.lit(30.0444), F.lit(31.2357)), 4).alias("km_to_centre"))


@query("p27_poll_interval", f"""with {READINGS}, lo as (select reading_id, cast(extract(hour from request_time) as bigint) as h,
  cast(extract(hour from (request_time at time zone 'UTC') at time zone 'Africa/Cairo') as bigint) as c from rd)
select reading_id, case when h < 7 then 1800 when h < 10 then 600 when h < 16 then 1200 when h < 19 then 600 when h < 23 then 1200 else 1800 end as utc_seconds,
  case when c < 7 then 1800 when c < 10 then 600 when c < 16 then 1200 when c < 19 then 600 when c < 23 then 1200 else 1800 end as cairo_seconds,
  case when c < 7 then 'night' when c < 10 then 'morning rush' when c < 16 then 'midday' when c < 19 then 'evening rush' when c < 23 then 'evening' else 'night' end as cairo_label
from lo""")
def poll_interval(spark, path):
    at = F.col("request_time")
    return t.readings(spark, path).select(
        "reading_id", lookups.poll_interval(at, None)["seconds"].cast("int").alias("utc_seconds"),
        lookups.poll_interval(at)["seconds"].cast("int").alias("cairo_seconds"),
        lookups.poll_interval(at)["label"].alias("cairo_label"))


@query("p29_anomaly_reasons", f"""with {VERDICTS}
select reading_id, anomaly_score, is_anomaly and (anomaly_score < -0.05 or road_closure or speed_drop_pct > 30) as backed,
  anomaly_score < 0 and (anomaly_score < -0.05 or road_closure or speed_drop_pct > 30) as is_anomaly,
  {ANOMALY_REASON} as reason from vd""")
def anomaly_reasons(spark, path):
    df = t.scored(spark, path)
    backed = (F.col("anomaly_score") < -0.05) | F.col("road_closure") | (F.col("speed_drop_pct") > 30)
    return df.select("reading_id", "anomaly_score", (F.col("is_anomaly") & backed).alias("backed"),
                     isolation_forest.is_anomaly(F.col("anomaly_score"), F.col("road_closure"), F.col("speed_drop_pct")).alias("is_anomaly"), texts.anomaly_reason(
        F.col("road_closure"), F.col("speed_drop_pct"), F.col("speed_deviation"), F.col("weather_rain"), F.col("anomaly_score")).alias("reason"))


@query("p30_prediction_reasons", f"""with {VERDICTS}, rs as (select reading_id, [x for x in [
    case when road_closure then 'road_closure flag is active' end,
    case when is_rush_hour = 1 then concat('rush hour (hour=', hour, ')') end,
    case when speed_deviation < -5 then concat('speed ', {rt('abs(speed_deviation)', 1)}, 'km/h below average') end,
    case when speed_deviation > 5 then concat('speed ', {rt('speed_deviation', 1)}, 'km/h above average') end,
    case when weather_rain > 0 then concat('rain: ', cast(weather_rain as varchar), 'mm') end] if x is not null] as items from vd)
select reading_id, coalesce(items[1], '') as top_reason_1, coalesce(items[2], '') as top_reason_2, coalesce(items[3], '') as top_reason_3 from rs""")
def prediction_reasons(spark, path):
    reasons = texts.prediction_reasons(F.col("road_closure"), F.col("is_rush_hour") == 1, F.col("hour"),
                                       F.col("speed_deviation"), F.col("weather_rain"))
    df = t.scored(spark, path).withColumn("_reasons", reasons)
    return df.select("reading_id", *[texts.nth_or_blank(F.col("_reasons"), i).alias(f"top_reason_{i + 1}") for i in range(3)])


_ADVICE = " ".join(f"when weather_main in ({', '.join(map(quoted, names))}) then {quoted(text)}" for names, text, _ in fv.CONDITION_ADVISORIES)
_SEVERITY = " ".join(f"when weather_main in ({', '.join(map(quoted, names))}) then {quoted(s)}" for names, _, s in fv.CONDITION_ADVISORIES)


@query("p31_weather_advisory", f"""with {READINGS}
select reading_id, case when weather_rain > 0 and weather_main = 'Thunderstorm' then concat('⛈️ Thunderstorm active (', cast(weather_rain as varchar), 'mm) → expect major delays')
  when weather_rain > 5 then concat('🌧️ Heavy rain (', cast(weather_rain as varchar), 'mm) → significant congestion increase')
  when weather_rain > 0 then concat('🌧️ Light rain (', cast(weather_rain as varchar), 'mm) → expect slower traffic')
  {_ADVICE} else concat('🌤️ ', weather_main, ' → monitoring traffic conditions') end as text,
  case when weather_rain > 0 and weather_main = 'Thunderstorm' then 'severe' when weather_rain > 5 then 'heavy' when weather_rain > 0 then 'moderate'
  {_SEVERITY} else 'neutral' end as severity from rd""")
def weather_advisory(spark, path):
    advice = texts.weather_advisory(F.col("weather_rain"), F.col("weather_main"))
    return t.readings(spark, path).withColumn("_a", advice).select("reading_id", "_a.text", "_a.severity")


@query("p32_relative_age", f"""with {READINGS}, ag as (select reading_id, cast(floor((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(request_time)) / 6e7) as bigint) as m from rd)
select reading_id, case when m < 1 then 'just now' when m < 60 then concat(m, ' min ago') else concat(m // 60, 'h ', m % 60, 'm ago') end as age from ag""")
def relative_age(spark, path):
    return t.readings(spark, path).select("reading_id", texts.relative_age(F.col("request_time"), t.as_of()).alias("age"))


@query("p28_target_times", f"""with {READINGS}
select reading_id, h.horizon, {ts("request_time + to_minutes(h.mins)")} as target_time
from rd, (values ('20min', 20), ('30min', 30), ('60min', 60), ('2h', 0)) h(horizon, mins)""")
def target_times(spark, path):
    horizons = F.explode(F.array(*[F.lit(h) for h in ("20min", "30min", "60min", "2h")]))
    return t.readings(spark, path).select("reading_id", "request_time", horizons.alias("horizon")).select(
        "reading_id", "horizon", lookups.target_time(F.col("request_time"), F.col("horizon")).alias("target_time"))


@query("p34_bands", f"""with {SCORED}, bn as (select reading_id, confidence * 100 as score, current_speed - free_flow_speed as drop_kmh, {ri('congestion_ratio * 100')} as kpi,
   reading_id % 600 - 30 as delay from sc)
select reading_id, case when score >= 95 then 'free' when score >= 80 then 'moderate' when score >= 50 then 'heavy' else 'severe' end as score_band,
  case when score >= 99 then 'free' when score >= 90 then 'moderate' else 'severe' end as pass_band,
  case when drop_kmh > 5 then 'down' when drop_kmh < -5 then 'up' else 'flat' end as trend,
  case when kpi >= 75 then 'Free Flow' when kpi >= 50 then 'Moderate' else 'Congested' end as kpi_band,
  cast(case when delay > 0 then floor(delay / 6e1 + 0.5) else 0 end as bigint) as delay_minutes from bn""")
def bands(spark, path):
    df = t.with_ratio(t.readings(spark, path))
    score = F.col("confidence") * 100
    return df.select(
        "reading_id", lookups.score_band(score).alias("score_band"), lookups.pass_rate_band(score).alias("pass_band"),
        lookups.trend_band(F.col("current_speed") - F.col("free_flow_speed")).alias("trend"),
        lookups.kpi_band(F.round(rounded(F.col("congestion_ratio") * 100, 0))).alias("kpi_band"),
        texts.delay_minutes(F.col("reading_id") % 600 - 30).alias("delay_minutes"))


@query("p25_message_district", f"""with {MESSAGES}, {DISTRICTS.replace('from rd where', 'from ms where')}
select ms.reading_id, case when reading_id % 4 = 0 then 'Given' when requested_lat is null or requested_lat = 0 then 'Unknown' else place end as district
from ms left join ds on lat = requested_lat and lon = requested_lon""")
def message_districts(spark, path):
    given = F.when(F.col("reading_id") % 4 == 0, F.lit("Given")).when(F.col("reading_id") % 4 == 1, F.lit(""))
    return geo.with_message_district(t.messages(spark, path).withColumn("district", given)).select("reading_id", "district")


# places of all users and coordinates of all events, without ties
_PLACES = """pl as (select distinct user_id as place_id, 2.9e1 + user_id * 6.180339887e-1 % 1e0 * 1.7e0 as lat, 3.05e1 + user_id * 7.548776662e-1 % 1e0 * 1.9e0 as lon from events),
 pt as (select event_id as reading_id, case when event_id % 53 = 0 then null else 2.85e1 + event_id * 3.247179572e-1 % 1e0 * 3e0 end as lat,
    case when event_id % 50 = 0 then -1.7999e2 else 3e1 + event_id * 5.698402910e-1 % 1e0 * 3e0 end as lon from events)"""


def _places(spark, path):
    events = spark.read.parquet(f"{path}/events.parquet")
    places = events.select("user_id").distinct().selectExpr(
        "user_id AS place_id", "2.9e1 + user_id * 6.180339887e-1 % 1e0 * 1.7e0 AS lat", "3.05e1 + user_id * 7.548776662e-1 % 1e0 * 1.9e0 AS lon")
    points = events.selectExpr(
        "event_id AS reading_id", "CASE WHEN event_id % 53 = 0 THEN NULL ELSE 2.85e1 + event_id * 3.247179572e-1 % 1e0 * 3e0 END AS lat",
        "CASE WHEN event_id % 50 = 0 THEN -1.7999e2 ELSE 3e1 + event_id * 5.698402910e-1 % 1e0 * 3e0 END AS lon")
    return points, places


@query("j07_nearest_of_a_table", f"""with {_PLACES}, ds as (select pt.reading_id, pl.place_id, {haversine('pt.lat', 'pt.lon', 'pl.lat', 'pl.lon')} as km from pt join pl on pt.lat is not null),
 rk as (select *, row_number() over (partition by reading_id order by km, place_id) as rn from ds)
select pt.reading_id, place_id, {r('km', 3)} as km from pt left join rk on rk.reading_id = pt.reading_id and rn = 1""")
def nearest_of_a_table(spark, path):
    """The nearest of all users' places for the coordinates of every event; some are far away, some missing."""
    points, places_ = _places(spark, path)
    return places.nearest_place(points, places_, "lat", "lon", "place_id").select(
        "reading_id", "nearest.place_id", rounded(F.col("nearest.km"), 3).alias("km"))


@query("p18_rectangles_of_a_table", f"""with {_PLACES}, rc as (select place_id, lat as south, lat + place_id % 17 * 3e-3 * power(4, place_id % 4) as north,
    lon as west, lon + place_id % 13 * 4e-3 * power(4, place_id % 4) as east from pl),
 hd as (select pt.reading_id, min(place_id) as place_id from pt join rc on pt.lat between south and north and pt.lon between west and east group by 1)
select pt.reading_id, place_id from pt left join hd using (reading_id)""")
def rectangles_of_a_table(spark, path):
    """The first rectangle, of one per user in four sizes, that holds the coordinates of each event."""
    points, places_ = _places(spark, path)
    rectangles = places_.selectExpr("place_id", "lat AS south", "lat + place_id % 17 * 3e-3 * power(4, place_id % 4) AS north",
                                    "lon AS west", "lon + place_id % 13 * 4e-3 * power(4, place_id % 4) AS east")
    return places.first_rectangle(points, rectangles, "lat", "lon", "place_id").select("reading_id", "rectangle.place_id")
