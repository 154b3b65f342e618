"""City snapshot: one document over the newest record of every road."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.lookups import code_name
from roadweave.functions.numeric import rounded


def _top(latest: DataFrame, order: list, count: int, shown, keep) -> DataFrame:
    """The first ``count`` rows by ``order``, then those that ``keep``, as one ordered array."""
    names = [f"_o{i}" for i in range(len(order))]
    best = latest.withColumns(dict(zip(names, order))).orderBy(*names).limit(count).filter(keep)
    entries = F.array_sort(F.collect_list(F.struct(*names, shown.alias("entry"))))
    return best.agg(F.transform(entries, lambda e: e["entry"]).alias("entries"))


def city_snapshot(latest: DataFrame, hotspots: int = 4, free_flowing: int = 2) -> DataFrame:
    """One row.  ``latest`` has one row per road: location_name, district, current_speed,
    congestion_level, congestion_ratio, weather_main, rain_mm, temperature, request_time,
    is_anomaly, first_seen, trend_30min.

    The class filter of both lists comes after the top-n, so a list may be shorter than n.
    """
    level = F.col("congestion_level")
    rank = code_name(F.coalesce(level, F.lit("Free Flow")), fv.SEVERITY_RANK, default=F.lit(5))
    worst = _top(
        latest, [rank, F.coalesce("congestion_ratio", F.lit(1.0)), F.col("location_name")], hotspots,
        F.struct(
            F.col("location_name").alias("name"), "district",
            rounded(F.coalesce("current_speed", F.lit(0.0)), 1).alias("speed"), level.alias("class"),
            rounded(F.col("trend_30min"), 1).alias("trend_30min")),
        level.isin("Severe", "Heavy", "Closed"))
    best = _top(
        latest, [-F.coalesce("congestion_ratio", F.lit(0.0)), F.col("location_name")], free_flowing,
        F.struct(F.col("location_name").alias("name"),
                 rounded(F.coalesce("current_speed", F.lit(0.0)), 1).alias("speed"), level.alias("class")),
        level == "Free Flow")
    total = F.count(F.lit(1))

    def share(name):
        hit = F.count_if(F.coalesce(level == name, F.lit(False)))
        return F.when(total > 0, rounded(hit * F.lit(100.0) / total, 1)).otherwise(F.lit(0.0))

    weather = F.struct(
        F.coalesce("weather_main", F.lit("Clear")).alias("main"),
        F.coalesce("rain_mm", F.lit(0.0)).alias("rain_mm"),
        F.coalesce("temperature", F.lit(0.0)).alias("temperature"))
    first = F.struct("first_seen", "location_name")
    return latest.agg(
        F.min_by("request_time", first).alias("timestamp"),
        F.when(total > 0, rounded(F.coalesce(F.avg("current_speed"), F.lit(0.0)), 1)).alias("city_avg_speed"),
        share("Heavy").alias("city_heavy_pct"), share("Severe").alias("city_severe_pct"),
        share("Closed").alias("city_closed_pct"),
        total.alias("n_locations"),
        F.min_by(weather, first).alias("weather"),
        F.count_if(F.coalesce(F.col("is_anomaly").cast("int") == 1, F.lit(False))).alias("anomaly_count"),
    ).withColumns({"top_hotspots": worst.scalar(), "free_flowing": best.scalar()})


def with_snapshot_key(snapshot: DataFrame) -> DataFrame:
    """Stable hash of the document: its JSON text with the fields in alphabetical order."""
    return snapshot.withColumn("snapshot_key", F.md5(F.to_json(F.struct(*sorted(snapshot.columns)))))
