"""Data quality of messages with every kind of defect."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.sql import AS_OF, QUALITY, pct, quoted, r, ri, ts
from roadweave import fixed_values as fv
from roadweave.functions.lookups import check_label
from roadweave.functions.quality import route
from roadweave.plans import dashboard

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


@query("q09_quality_checks", f"""with {QUALITY}
select reading_id, location_name, to_json(issues) as issues, cast(issues_count as bigint) as issues_count,
  cast(quality_score as bigint) as quality_score, fatal, passed from ql""")
def quality_checks(spark, path):
    return t.quality(spark, path).select(
        "reading_id", "location_name", "issues", "issues_count", "quality_score", "fatal", "passed")


@query("q10_routing", f"""with {QUALITY}
select case when not passed then 'fail' when quality_score < 80 and issues_count > 0 then 'warn' else 'pass' end as route, count(*) as readings
from ql group by 1""")
def routing(spark, path):
    where = route(F.col("quality_score"), F.col("passed"), F.col("issues_count"))
    return t.quality(spark, path).groupBy(where.alias("route")).agg(F.count(F.lit(1)).alias("readings"))


@query("q11_quality_totals", f"""with {QUALITY}
select count(*) as total, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed,
  count(*) filter (where passed and issues_count > 0) as warnings, count(*) filter (where fatal) as fatal, {pct('passed')} as pass_rate from ql""")
def quality_totals(spark, path):
    return dashboard.quality_totals(t.quality(spark, path))


_LABEL = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in fv.CHECK_LABELS.items())


@query("q11_top_checks", f"""with {QUALITY}, un as (select unnest(issues) as i from ql)
select i.check as check_name, count(*) as count, case i.check {_LABEL} else i.check end as label from un group by 1, 3 order by 2 desc, 1 limit 3""")
def top_checks(spark, path):
    return dashboard.top_checks(t.quality(spark, path)).withColumn("label", check_label(F.col("check_name")))


_RECENT = f"checked_at > {AS_OF} - interval 240 hours"


@query("a33_quality_overview", f"""with {QUALITY}
select count(*) as total_messages, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed,
  count(*) filter (where passed and issues_count > 0) as warnings, {pct('passed')} as pass_rate,
  coalesce(nullif({ri('avg(quality_score)')}, 0), 100) as avg_score, coalesce(nullif(cast(min(quality_score) as bigint), 0), 100) as min_score,
  coalesce(nullif(cast(max(quality_score) as bigint), 0), 100) as max_score from ql where {_RECENT}""")
def quality_overview(spark, path):
    return dashboard.quality_overview(t.quality(spark, path), t.as_of(), hours=240)


@query("a34_top_issues", f"""with {QUALITY}, un as (select unnest(issues) as i from ql where {_RECENT})
select i.check as check_name, i.severity as severity, count(*) as count from un group by 1, 2 order by 3 desc, 1, 2 limit 5""")
def top_issues(spark, path):
    return dashboard.top_issues(t.quality(spark, path), t.as_of(), hours=240)


@query("a35_top_problem_roads", f"""with {QUALITY}
select location_name, count(*) as check_count, cast(sum(issues_count) as bigint) as total_issues, {ri('avg(quality_score)')} as avg_score
from ql where {_RECENT} and issues_count > 0 group by 1 order by 3 desc, 1 nulls first limit 5""")
def top_problem_roads(spark, path):
    return dashboard.top_problem_roads(t.quality(spark, path), t.as_of(), hours=240)


_EVENTS = f"""{ts('checked_at')} as checked_at, location_name, cast(quality_score as bigint) as quality_score, passed,
  cast(issues_count as bigint) as issues_count, to_json(issues) as issues"""


@query("d14_quality_events", f"with {QUALITY} select {_EVENTS} from ql where {_RECENT} order by checked_at desc, event_id desc limit 100")
def quality_events(spark, path):
    return dashboard.quality_events(t.quality(spark, path), t.as_of(), hours=240)


@query("d14_quality_events_with_issues",
       f"with {QUALITY} select {_EVENTS} from ql where {_RECENT} and issues_count > 0 order by ql.checked_at desc, event_id desc limit 100")
def quality_events_with_issues(spark, path):
    return dashboard.quality_events(t.quality(spark, path), t.as_of(), hours=240, only_issues=True)


@query("a29_quality_pass_rate", f"""with {QUALITY}
select count(*) as total, count(*) filter (where passed) as passed, {pct('passed')} as pass_rate from ql where {_RECENT}""")
def quality_pass_rate(spark, path):
    return dashboard.quality_pass_rate(t.quality(spark, path), t.as_of(), hours=240)


_COLUMNS = ["reading_id", "request_time", "location_name", "requested_lat", "requested_lon", "current_speed", "free_flow_speed"]
_MISSING = " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as missing, {r(f'count(*) filter (where {c} is null) * 1e2 / count(*)', 2)} as missing_pct from ms"
    for c in _COLUMNS)


@query("q13_missing_values", f"with {QUALITY} select * from ({_MISSING}) where missing > 0")
def missing_values(spark, path):
    from roadweave.plans.exploration import missing_values as report

    return report(t.messages(spark, path).select(*_COLUMNS))
