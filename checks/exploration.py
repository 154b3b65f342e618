"""Exploration report."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.sql import EXPLORE, pct, r, ts
from roadweave import fixed_values as fv
from roadweave.functions.features import with_exploration_columns
from roadweave.operators.lags import with_lags
from roadweave.plans import exploration as ex
from roadweave.plans.alerts import with_round

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


def explored(spark, path):
    readings = t.plain_readings(spark, path).select(
        "reading_id", "request_time", "location_name", "requested_lat", "requested_lon", "frc", "current_speed",
        "free_flow_speed", "current_travel_time", "free_flow_travel_time", "confidence", "road_closure")
    return with_exploration_columns(readings)


@query("p16_exploration_columns", f"""with {EXPLORE}
select reading_id, hour, minute, day_of_week, cast(date as varchar) as date, congestion_ratio, speed_drop_pct, delay_seconds, is_rush_hour,
  road_type, congestion_level from el""")
def exploration_columns(spark, path):
    return explored(spark, path).select("reading_id", "hour", "minute", "day_of_week", "date", "congestion_ratio", "speed_drop_pct",
                                        "delay_seconds", "is_rush_hour", "road_type", "congestion_level")


@query("f07_low_confidence", f"""with {EXPLORE}
select location_name, {ts('request_time')} as request_time, current_speed, confidence from el where confidence < 0.5e0
order by el.request_time, reading_id limit 10""")
def low_confidence(spark, path):
    return ex.low_confidence(explored(spark, path))


@query("f07_low_confidence_share", f"""with {EXPLORE}
select count(*) filter (where confidence < 0.5e0) as low_confidence, {pct('confidence < 0.5e0')} as pct from el""")
def low_confidence_share(spark, path):
    return ex.low_confidence_share(explored(spark, path))


# ids are left out, so that readings equal in the rest count as duplicates


_PLAIN_COLUMNS = "reading_id, location_name, frc, confidence, road_closure, congestion_ratio, current_speed"


@query("q12_sanity_counts", f"""with {EXPLORE}, pl as (select {_PLAIN_COLUMNS} from el union all select {_PLAIN_COLUMNS} from el where reading_id % 20 = 0)
select (select count(*) from pl) - (select count(*) from (select distinct * from pl)) as duplicate_rows,
  count(*) filter (where current_speed < 0) as negative_speed, count(*) filter (where current_speed > 150) as speed_over_150,
  count(*) filter (where confidence < 0 or confidence > 1) as confidence_out_of_range, count(*) filter (where congestion_ratio > 1) as ratio_over_1,
  count(*) filter (where road_closure) as road_closures from pl""")
def sanity_counts(spark, path):
    """Every twentieth reading is there twice."""
    rows = explored(spark, path).select(*_PLAIN_COLUMNS.split(", "))
    return ex.sanity_counts(rows.unionByName(rows.filter("reading_id % 20 = 0")))


@query("q14_suspicious_counts", f"""with {EXPLORE}, pv as (select *, lag(current_speed) over (partition by location_name order by request_time, reading_id) as previous_speed from el)
select count(*) filter (where current_speed = 0 and not road_closure) as zero_speed_open_road,
  count(*) filter (where current_speed > free_flow_speed) as faster_than_free_flow, count(*) filter (where confidence < 0.5e0) as low_confidence,
  count(*) filter (where previous_speed - current_speed >= 40) as sudden_drop from pv""")
def suspicious_counts(spark, path):
    df = t.plain_readings(spark, path).select(
        "reading_id", "request_time", "location_name", "current_speed", "free_flow_speed", "confidence", "road_closure")
    return ex.suspicious_counts(with_lags(df, ["location_name"], "request_time", "reading_id", {"previous_speed": ("current_speed", 1)}))


@query("q15_dataset_profile", f"""with {EXPLORE}
select {ts('min(request_time)')} as first_time, {ts('max(request_time)')} as last_time, count(distinct location_name) as roads,
  cast(to_json(list_sort(list(distinct frc))) as varchar) as frc_values, count(*) as rows, 22 as columns from el""")
def dataset_profile(spark, path):
    return ex.dataset_profile(explored(spark, path))


@query("a11_round_summary", f"""with {EXPLORE}
select {ts("time_bucket(interval '1 hour', request_time)")} as round_start, count(*) as locations_fetched,
  {r('coalesce(avg(nullif(current_speed, 0)), 0)', 1)} as avg_speed from el group by 1""")
def round_summary(spark, path):
    return ex.round_summary(with_round(t.plain_readings(spark, path), 3600))


@query("a12_frc_breakdown", f"""with {EXPLORE}
select frc, road_type, count(*) as count, {r('count(*) * 1e2 / sum(count(*)) over ()', 1)} as pct from el group by 1, 2""")
def frc_breakdown(spark, path):
    return ex.frc_breakdown(explored(spark, path))


def _histogram(columns, bins):
    return " union all ".join(
        f"select '{c}' as column_name, cast(least({bins}, floor(({c} - lo) * {bins} / (hi - lo)) + 1) as bigint) as bin, count(*) as count "
        f"from el, (select min({c}) as lo, max({c}) as hi from el) group by 1, 2" for c in columns)


@query("a13_speed_histogram", f"with {EXPLORE} " + _histogram(["current_speed", "free_flow_speed"], 40))
def speed_histogram(spark, path):
    return ex.histogram(explored(spark, path), ["current_speed", "free_flow_speed"], 40)


@query("a13_confidence_histogram", f"with {EXPLORE} " + _histogram(["confidence"], 30))
def confidence_histogram(spark, path):
    return ex.histogram(explored(spark, path), ["confidence"], 30)


@query("a14_speeds_by_road", f"""with {EXPLORE}, sp as (select location_name, {r('avg(current_speed)', 1)} as avg_speed, {r('avg(free_flow_speed)', 1)} as avg_free_flow
  from el group by 1) select *, {r('avg_free_flow - avg_speed', 1)} as gap from sp""")
def speeds_by_road(spark, path):
    return ex.speeds_by_road(explored(spark, path))


_DESCRIBED = ["current_speed", "congestion_ratio", "confidence", "delay_seconds"]


@query("a15_describe", f"with {EXPLORE} " + " union all ".join(
    f"select '{c}' as column_name, count({c}) as count, {r(f'avg({c})', 2)} as mean, {r(f'stddev_samp({c})', 2)} as std, {r(f'min({c})', 2)} as min, "
    + ", ".join(f"{r(f'quantile_cont(cast({c} as double), {q})', 2)} as {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    + f", {r(f'max({c})', 2)} as max from el" for c in _DESCRIBED))
def describe(spark, path):
    return ex.describe(explored(spark, path), _DESCRIBED, digits=2)


@query("a15_describe_text", f"with {EXPLORE} " + " union all ".join(
    f"(select '{c}' as column_name, (select count({c}) from el) as count, (select count(distinct {c}) from el) as unique, {c} as top, count(*) as freq "
    f"from el group by {c} order by count(*) desc, {c} limit 1)" for c in ("location_name", "frc", "congestion_level", "day_of_week")))
def describe_text(spark, path):
    return ex.describe_text(explored(spark, path), ["location_name", "frc", "congestion_level", "day_of_week"])


@query("a16_level_distribution", f"""with {EXPLORE}
select congestion_level, count(*) as count, {r('count(*) * 1e2 / sum(count(*)) over ()', 1)} as pct,
  cast(list_position(['Free Flow', 'Light', 'Moderate', 'Heavy', 'Severe', 'Unknown'], congestion_level) as bigint) as position from el group by 1""")
def level_distribution(spark, path):
    return ex.level_distribution(explored(spark, path))


@query("a17_level_cross_tab", f"with {EXPLORE} select location_name, " + ", ".join(
    pct(f"congestion_level = '{n}'", 2) + f' as "{n}"' for n in fv.EDA_LEVELS) + " from el group by 1")
def level_cross_tab(spark, path):
    return ex.level_cross_tab(explored(spark, path))


@query("a18_speed_by_hour", f"""with {EXPLORE}
select hour, {r('avg(current_speed)', 2)} as avg_speed, hour between 7 and 9 or hour between 16 and 19 as is_rush from el group by 1""")
def speed_by_hour(spark, path):
    return ex.speed_by_hour(explored(spark, path))


def _rush(metric, expression, rush="is_rush_hour = 'Rush hour'"):
    a, b = expression.format(rush), expression.format(f"not ({rush})")
    return f"select '{metric}' as metric, {r(a, 2)} as rush_hour, {r(b, 2)} as off_peak, {r(f'{b} - {a}', 2)} as difference from el"


@query("a19_rush_comparison", f"with {EXPLORE} " + " union all ".join([
    _rush("avg_speed", "avg(current_speed) filter (where {})"), _rush("avg_ratio", "avg(congestion_ratio) filter (where {})"),
    _rush("avg_delay", "avg(delay_seconds) filter (where {})"), _rush("road_closures", "count(*) filter (where {} and road_closure)"),
    _rush("readings", "count(*) filter (where {})")]))
def rush_comparison(spark, path):
    return ex.rush_comparison(explored(spark, path))


_ROAD = f"""{r('avg(current_speed)', 2)} as avg_speed, {r('avg(congestion_ratio)', 2)} as avg_congestion, count(current_speed) as readings,
  {r('avg(delay_seconds)', 2)} as avg_delay_s, count(*) filter (where road_closure) as road_closures"""


@query("a20_road_summary", f"""with {EXPLORE}
select location_name, {_ROAD}, {r('min(current_speed)', 2)} as min_speed, {r('max(current_speed)', 2)} as max_speed,
  {r('stddev_samp(current_speed)', 2)} as std_speed, {r('avg(confidence)', 2)} as avg_confidence from el group by 1""")
def road_summary(spark, path):
    return ex.road_summary(explored(spark, path))


@query("a21_box_plot", f"""with {EXPLORE}, qu as (select location_name, quantile_cont(current_speed, 0.25) as q1, quantile_cont(current_speed, 0.5) as q2,
  quantile_cont(current_speed, 0.75) as q3 from el group by 1)
select location_name, {r('q1', 2)} as q1, {r('q2', 2)} as median, {r('q3', 2)} as q3, {r('q1 - 1.5e0 * (q3 - q1)', 2)} as low_fence,
  {r('q3 + 1.5e0 * (q3 - q1)', 2)} as high_fence from qu""")
def box_plot(spark, path):
    return ex.box_plot(explored(spark, path))


@query("a22_map_summary", f"with {EXPLORE} select location_name, requested_lat, requested_lon, {_ROAD} from el group by 1, 2, 3")
def map_summary(spark, path):
    return ex.map_summary(explored(spark, path))


@query("a23_closure_rate", f"""with {EXPLORE}
select location_name, count(*) filter (where road_closure) as closures, count(road_closure) as readings, {pct('road_closure')} as pct from el group by 1""")
def closure_rate(spark, path):
    return ex.closure_rate(explored(spark, path))


@query("a23_closure_share", f"with {EXPLORE} select count(*) filter (where road_closure) as closures, count(*) as readings, {pct('road_closure')} as pct from el")
def closure_share(spark, path):
    return ex.closure_share(explored(spark, path))


@query("a24_correlations", f"with {EXPLORE} " + " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, {r(f'corr({a}, {b})', 2)} as correlation from el" for a in ex.NUMERIC for b in ex.NUMERIC))
def correlations(spark, path):
    return ex.correlations(explored(spark, path))


@query("a24_ranked_correlations", f"with {EXPLORE} " + " union all ".join(
    f"select '{b}' as column_name, {r(f'corr(current_speed, {b})', 2)} as correlation from el" for b in ex.NUMERIC if b != "current_speed"))
def ranked_correlations(spark, path):
    return ex.ranked_correlations(explored(spark, path))


@query("a25_key_findings", f"""with {EXPLORE}, ro as (select location_name, {r('avg(congestion_ratio)', 2)} as ratio from el group by 1)
select count(*) as readings, count(distinct location_name) as roads, {ts('min(request_time)')} as first_time, {ts('max(request_time)')} as last_time,
  {r('avg(current_speed)', 1)} as avg_speed, {r('avg(free_flow_speed)', 1)} as avg_free_flow, {r('avg(free_flow_speed - current_speed)', 1)} as avg_speed_lost,
  {r('avg(delay_seconds)', 1)} as avg_delay, {pct("congestion_level in ('Heavy', 'Severe')")} as heavy_or_severe_pct,
  (select location_name from ro order by ratio, location_name limit 1) as most_congested, (select min(ratio) from ro) as most_congested_ratio,
  (select location_name from ro order by ratio desc, location_name limit 1) as least_congested, (select max(ratio) from ro) as least_congested_ratio,
  count(*) filter (where road_closure) as closures, {pct('confidence < 0.5e0')} as low_confidence_pct, {pct('current_speed is null')} as missing_speed_pct from el""")
def key_findings(spark, path):
    return ex.key_findings(explored(spark, path))


@query("w16_timeline", f"with {EXPLORE} select location_name, {ts('request_time')} as request_time, current_speed, congestion_ratio, reading_id from el")
def timeline(spark, path):
    return ex.timeline(explored(spark, path))
