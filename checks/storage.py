"""What is written to tables, files and state, and read back."""

from __future__ import annotations

import uuid
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import tables as t
from checks.ingest import ORACLE as INGEST
from checks.ingest import _partly_unknown, statistics
from checks.series import _LAG_NAMES, _LAGS, _WINDOW
from checks.sql import SCORED, WINDOWS, r, ts
from checks.streams import finished, folder, stored
from checks.warehouse import ORACLE as WAREHOUSE
from checks.warehouse import staging
from roadweave import fixed_values as fv
from roadweave.functions.numeric import rounded
from roadweave.plans import mart_refresh, marts, stats
from roadweave.plans.warehouse import enriched_facts, fact_rows
from roadweave.sources import dimensions, stats_document, tables
from roadweave.streaming import jobs, state, windows

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(function):
        QUERIES[name] = function
        ORACLE[name] = sql
        return function
    return add


@query("s05_appended_readings", f"""with {SCORED} select reading_id, {ts('request_time')} as request_time, location_name, current_speed,
  cast(request_time as date)::varchar as event_date from sc where cast(request_time as date) >= date '2024-01-16'""")
def appended_readings(spark, path):
    """Two appends to the date-partitioned table; days before the 16th are not opened."""
    root, rows = folder(spark), t.plain_readings(spark, path)
    middle = F.lit("2024-01-12 07:30:00").cast("timestamp")
    for part in (rows.filter(F.col("request_time") < middle), rows.filter(F.col("request_time") >= middle)):
        tables.append_table(part, root, "raw_events")
    return tables.read_table(spark, root, "raw_events", date(2024, 1, 16)).select(
        "reading_id", "request_time", "location_name", "current_speed", "event_date")


@query("s06_csv_round_trip", f"""with {SCORED} select reading_id, {ts('request_time')} as request_time, location_name, frc, current_speed, free_flow_speed,
  road_closure from sc""")
def csv_round_trip(spark, path):
    file = f"{folder(spark)}/csv"
    rows = t.readings(spark, path).select("reading_id", "request_time", "location_name", "frc", "current_speed", "free_flow_speed", "road_closure")
    tables.write_csv(rows, file)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return tables.read_csv(spark, file, kinds)


@query("s07_stored_statistics", INGEST["a10_location_statistics"])
def stored_statistics(spark, path):
    file = f"{folder(spark)}/stats"
    stats_document.write_stats(statistics(spark, path), file)
    found = stats_document.read_stats(spark, file)
    return found.withColumns({m: rounded(F.col(m), 4) for m in stats.MEASURES})


@query("p23_fallback_statistics", """select event_id as reading_id, 24.0e0 as avg_speed, 34.0e0 as avg_free_flow_speed, 0.71e0 as avg_congestion_ratio,
  160.0e0 as avg_delay_seconds, 'city_wide' as source from events""")
def fallback_statistics(spark, path):
    """Without a stored document every reading gets the constants."""
    found = stats_document.read_stats(spark, f"{folder(spark)}/missing")
    return stats.with_location_stats(_partly_unknown(spark, path), found).select(
        "reading_id", *[F.col(f"stats.{m}").alias(m) for m in stats.MEASURES], "stats.source")


@query("s08_exported_partitions", """with n as (select (select count(*) from events) as fact_traffic, 168 as dim_time)
select 'fact_traffic' as table_name, ds, fact_traffic as rows from n, (values ('2024-02-20'), ('2024-03-10')) d(ds)
union all select 'dim_time', ds, dim_time from n, (values ('2024-02-20'), ('2024-03-10')) d(ds)""")
def exported_partitions(spark, path):
    """Three weekly exports of the warehouse; the one older than 30 days has expired."""
    database, root = f"export_{uuid.uuid4().hex}", folder(spark)
    content = {"fact_traffic": t.fact(spark, path), "dim_time": dimensions.seed_times(spark)}
    last = date(2024, 3, 10)
    for days in (40, 19, 0):
        tables.export_warehouse(content, database, last - timedelta(days=days), f"{root}/warehouse")
    tables.expire_exports(spark, database, last)
    found = [spark.table(f"{database}.{name}").groupBy("ds").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table_name"), F.col("ds").cast("string").alias("ds"), "rows") for name in content]
    return found[0].unionByName(found[1])


_SEED = ", ".join("({}, '{}', {}e0, {}e0, '{}')".format(i, name.replace("'", "''"), lat, lon, district)
                  for i, (name, lat, lon, district, *_) in enumerate(fv.SEED_ROADS, 1))


@query("s11_seed_roads", f"""with {SCORED}, dl(location_key, location_name, lat, lon, district) as (values {_SEED})
select dl.location_key::bigint as location_key, dl.location_name, dl.district, dl.lat, dl.lon, count(*) as readings, {r('avg(current_speed)', 2)} as avg_speed
from sc join dl on dl.location_key = user_id % 25 + 1 group by all""")
def seed_roads(spark, path):
    """The given roads, with the events mapped to them."""
    roads = dimensions.seed_locations(spark).select("location_key", "location_name", "district", "lat", "lon")
    rows = t.readings(spark, path).select((F.col("user_id") % 25 + 1).alias("location_key"), "current_speed")
    counted = rows.groupBy("location_key").agg(F.count(F.lit(1)).alias("readings"), rounded(F.avg("current_speed"), 2).alias("avg_speed"))
    return roads.join(counted, "location_key")


@query("s15_stored_hourly_mart", WAREHOUSE["a02_hourly_traffic_summary"])
def stored_hourly_mart(spark, path):
    """All marts are rebuilt and stored; the hourly one is read back."""
    from checks.warehouse import QUERIES as built

    root = folder(spark)
    facts = staging(spark, path)
    saved = marts.build_marts(facts, root)["hourly_traffic_summary"]
    names = built["a02_hourly_traffic_summary"](spark, path).columns
    return saved.select(*names)


_MARTS = {"hourly_traffic_summary": "a02_hourly_traffic_summary", "daily_congestion_report": "a03_daily_congestion_report",
          "rush_hour_analysis": "a04_rush_hour_analysis", "weather_impact_analysis": "a05_weather_impact_analysis", "district_overview": "a06_district_overview"}


@query("s15_refreshed_marts", " union all ".join(
    f"select '{name}' as mart, concat_ws('|', *columns(*)) as line from ({WAREHOUSE[key]})" for name, key in _MARTS.items()))
def refreshed_marts(spark, path):
    """All five marts after three refreshes: the first days, then two batches that also change days already there; each reads its days only."""
    root, dims = folder(spark), t.dimensions(spark)
    readings = t.plain_readings(spark, path)
    middle, late = F.col("request_time") >= "2024-01-20 12:00:00", F.col("reading_id") % 10 == 0
    parts = [readings.filter(~middle & ~late), readings.filter(middle & ~late), readings.filter(late)]

    def facts_of(days):
        rows = spark.read.parquet(f"{root}/fact_traffic").filter(F.col("event_date").isin(days)).drop("event_date", "batch_id")
        return enriched_facts(rows, dims)

    for batch, part in enumerate(parts):
        tables.replace_batch(fact_rows(part, dims), root, "fact_traffic", batch)
        saved = mart_refresh.refresh_marts(spark, facts_of, root, mart_refresh.changed_dates(spark, root, batch - 1))
    lines = [df.select(F.lit(name).alias("mart"), F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).alias("line"))
             for name, df in saved.items()]
    return reduce(DataFrame.unionByName, lines)


@query("t03_stream_late_rows", f"""with {WINDOWS}
select {ts('window_start')} as window_start, location_name, avg_speed, reading_count from win where win.window_end <= (select max(request_time) from rd)""")
def stream_late_rows(spark, path):
    """All events of the first ten days come a second time, a batch after their windows closed: nothing changes."""
    root = folder(spark)
    events = spark.read.parquet(f"{path}/events.parquet")
    newest = events.orderBy(F.desc("ts")).limit(1)
    for part in (events, newest, events.filter("ts < '2024-01-11'"), newest):
        part.write.mode("append").parquet(f"{root}/in")
        # each run takes what has come since the last one as a batch
        rows = t.as_readings(spark.readStream.schema(events.schema).parquet(f"{root}/in"))
        finished(jobs.start(windows.road_windows(rows, ts="request_time"), root, "traffic_aggregates", f"{root}/state", once=True))
    return stored(spark, root, "traffic_aggregates").select("window_start", "location_name", "avg_speed", "reading_count")


@query("t06_restored_lags", f"""with {SCORED}, lg as (select reading_id, request_time, location_name, least(row_number() over w, 145) as buffered, {_LAGS} from sc {_WINDOW})
select reading_id, location_name, buffered, buffered >= 144 as is_warm, {', '.join(r(c, 4) + ' as ' + c for c in _LAG_NAMES)} from lg
where request_time >= timestamp '2024-01-20'""")
def restored_lags(spark, path):
    """A stream up to the 20th; its buffers are saved as a table, from which a stream of another width goes on."""
    state.use_rocksdb(spark)
    root = folder(spark)
    events = spark.read.parquet(f"{path}/events.parquet")
    events.filter("ts < '2024-01-20'").write.parquet(f"{root}/before")
    events.filter("ts >= '2024-01-20'").write.parquet(f"{root}/after")

    def run(part, held, target):
        rows = t.with_ratio(t.as_readings(spark.readStream.schema(events.schema).parquet(f"{root}/{part}"))).withColumn("event_time", F.col("request_time"))
        finished(jobs.start(state.stream_lags(rows, held), target, "road_lags", f"{root}/state_{part}", once=True))

    run("before", None, f"{root}/earlier")
    state.buffer_snapshot(spark, f"{root}/state_before").write.parquet(f"{root}/buffers")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", int(width) + 3)
        run("after", spark.read.parquet(f"{root}/buffers"), root)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    return stored(spark, root, "road_lags").select(
        "reading_id", "location_name", "buffered", "is_warm", *[rounded(F.col(c), 4).alias(c) for c in _LAG_NAMES])
