"""Star schema, marts and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.sql import MESSAGES, STAGING, mode_of, pct, r, ts
from roadweave.functions.numeric import rounded
from roadweave.plans import marts, warehouse
from roadweave.sources.tables import constraint_report

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


def staging(spark, path):
    return warehouse.enriched_facts(t.fact(spark, path), t.dimensions(spark))


@query("j01_fact_rows", f"""with {STAGING}
select {ts('event_time')} as event_time, user_id % 25 + 1 as location_key, cast(hour * 7 + day_of_week + 1 as bigint) as time_key,
  cast(weather_key as bigint) as weather_key, current_speed, free_flow_speed, {r('congestion_ratio', 4)} as congestion_ratio,
  road_closure, confidence, temperature, rain_mm, cast(humidity as bigint) as humidity, wind_speed from stg""")
def fact_rows(spark, path):
    return t.fact(spark, path).withColumn("congestion_ratio", rounded(F.col("congestion_ratio"), 4))


@query("p07_unmatched_keys", f"""with {MESSAGES}, ky as (select location_name is null or location_name = '' as no_road,
  try_cast(nullif(request_time, '') as timestamp) is null as no_time, free_flow_speed from ms)
select no_road, no_time, count(*) as readings, count(*) filter (where free_flow_speed is null or free_flow_speed <= 0) as without_free_flow
from ky group by 1, 2""")
def unmatched_keys(spark, path):
    """Defective messages keep a NULL key for what cannot be looked up."""
    rows = warehouse.lookup_keys(warehouse.enrich_readings(t.messages(spark, path)), t.dimensions(spark))
    return rows.groupBy(F.col("location_key").isNull().alias("no_road"), F.col("time_key").isNull().alias("no_time")).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.coalesce(F.col("free_flow_speed") <= 0, F.lit(True)) & F.coalesce(F.col("congestion_ratio") == 0, F.lit(True)))
        .alias("without_free_flow"))


@query("a01_stg_traffic_enriched", f"""with {STAGING}
select {ts('event_time')} as event_time, current_speed, free_flow_speed, {r('congestion_ratio', 4)} as congestion_ratio, road_closure, confidence,
  temperature, rain_mm, cast(humidity as bigint) as humidity, wind_speed, location_name, district, road_class, {r('lat', 6)} as lat, {r('lon', 6)} as lon,
  cast(hour as bigint) as hour, cast(day_of_week as bigint) as day_of_week, day_name, is_weekend, is_rush_hour, time_period,
  weather_condition, temp_range, rain_level, visibility_impact, congestion_level from stg""")
def stg_traffic_enriched(spark, path):
    df = staging(spark, path)
    return df.withColumns({c: rounded(F.col(c), n) for c, n in (("congestion_ratio", 4), ("lat", 6), ("lon", 6))})


_HOURLY = "location_name, district, road_class, hour, time_period, is_rush_hour, day_name, is_weekend"


@query("a02_hourly_traffic_summary", f"""with {STAGING}, {mode_of('stg', _HOURLY, 'congestion_level', 'md')}
select s.location_name, s.district, s.road_class, cast(s.hour as bigint) as hour, s.time_period, s.is_rush_hour, s.day_name, s.is_weekend,
  {r('avg(current_speed)', 1)} as avg_speed, {r('avg(free_flow_speed)', 1)} as avg_free_flow, {r('avg(congestion_ratio)', 3)} as avg_congestion_ratio,
  {r('avg(temperature)', 1)} as avg_temperature, count(*) as reading_count, count(*) filter (where road_closure) as closure_count,
  count(*) filter (where congestion_level = 'Free Flow') as free_flow_count, count(*) filter (where congestion_level = 'Moderate') as moderate_count,
  count(*) filter (where congestion_level = 'Heavy') as heavy_count, count(*) filter (where congestion_level = 'Severe') as severe_count,
  count(*) filter (where congestion_level = 'Closed') as closed_count, any_value(md.top_value) as dominant_congestion
from stg s join md using ({_HOURLY}) group by {', '.join('s.' + c.strip() for c in _HOURLY.split(','))}""")
def hourly_traffic_summary(spark, path):
    return marts.hourly_traffic_summary(staging(spark, path))


_DAILY = "report_date, location_name, district, road_class"


@query("a03_daily_congestion_report", f"""with {STAGING}, sd as (select *, cast(event_time as date) as report_date from stg),
 {mode_of('sd', _DAILY, 'congestion_level', 'md')}, {mode_of('sd', _DAILY, 'weather_condition', 'mw')}
select cast(sd.report_date as varchar) as report_date, sd.location_name, sd.district, sd.road_class, {r('avg(current_speed)', 1)} as avg_speed,
  {r('min(current_speed)', 1)} as min_speed, {r('max(current_speed)', 1)} as max_speed, {r('avg(free_flow_speed)', 1)} as avg_free_flow,
  {r('avg(congestion_ratio)', 3)} as avg_congestion_ratio, count(*) as total_readings, count(*) filter (where road_closure) as closure_count,
  {pct("congestion_level <> 'Free Flow'")} as pct_congested, any_value(md.top_value) as dominant_congestion,
  {r('avg(temperature)', 1)} as avg_temperature, {r('sum(coalesce(rain_mm, 0))', 2)} as total_rain_mm, any_value(mw.top_value) as dominant_weather
from sd join md using ({_DAILY}) join mw using ({_DAILY}) group by sd.report_date, sd.location_name, sd.district, sd.road_class""")
def daily_congestion_report(spark, path):
    return marts.daily_congestion_report(staging(spark, path))


@query("a04_rush_hour_analysis", f"""with {STAGING}
select location_name, district, road_class, is_rush_hour, {r('avg(current_speed)', 1)} as avg_speed, {r('avg(congestion_ratio)', 3)} as avg_congestion_ratio,
  count(*) as reading_count, {pct("congestion_level = 'Free Flow'")} as pct_free_flow,
  {pct("congestion_level in ('Heavy', 'Severe', 'Closed')")} as pct_congested from stg group by all""")
def rush_hour_analysis(spark, path):
    return marts.rush_hour_analysis(staging(spark, path))


@query("a05_weather_impact_analysis", f"""with {STAGING}, gr as (select weather_condition, temp_range, rain_level, visibility_impact,
  {r('avg(current_speed)', 1)} as avg_speed, {r('avg(congestion_ratio)', 3)} as avg_congestion_ratio, {r('avg(temperature)', 1)} as avg_temperature,
  {r('avg(rain_mm)', 2)} as avg_rain_mm, count(*) as total_readings, {pct("congestion_level = 'Free Flow'")} as pct_free_flow,
  {pct("congestion_level in ('Heavy', 'Severe')")} as pct_heavy_or_worse from stg group by all)
select *, {r(f"avg_speed - (select {r('avg(current_speed)', 1)} from stg where weather_condition = 'Clear')", 1)} as speed_diff_from_clear from gr""")
def weather_impact_analysis(spark, path):
    return marts.weather_impact_analysis(staging(spark, path))


@query("a06_district_overview", f"""with {STAGING}, {mode_of('stg', 'district', 'congestion_level', 'md')}
select stg.district, count(distinct location_name) as road_count, {r('avg(current_speed)', 1)} as avg_speed, {r('avg(congestion_ratio)', 3)} as avg_congestion_ratio,
  count(*) as total_readings, {pct("congestion_level <> 'Free Flow'")} as pct_congested, any_value(top_value) as dominant_congestion,
  {r('avg(temperature)', 1)} as avg_temperature from stg join md on md.district = stg.district group by stg.district""")
def district_overview(spark, path):
    return marts.district_overview(staging(spark, path))


@query("s16_constraint_report", """select * from (values ('dim_location.unique', 0), ('dim_location.not_null', 0), ('fact.location_key.exists', 0),
  ('dim_time.unique', 0), ('dim_time.not_null', 0), ('fact.time_key.exists', (select count(*) from events where extract(hour from ts) = 3)),
  ('dim_weather.unique', 0), ('dim_weather.not_null', 0), ('fact.weather_key.exists', (select count(*) from events where event_type = 'error')))
  v(rule, violations)""")
def constraints(spark, path):
    """Dimension rows are taken away on purpose so that the fact has orphans to find."""
    dims = t.dimensions(spark)
    return constraint_report(t.fact(spark, path), {
        "dim_location": (dims["dim_location"], "location_key", ["location_name"], ["location_name"]),
        "dim_time": (dims["dim_time"].filter("hour <> 3"), "time_key", ["hour", "day_of_week"], ["day_name", "time_period"]),
        "dim_weather": (dims["dim_weather"].filter("condition <> 'Dust'"), "weather_key", ["condition"], ["condition"]),
    })
