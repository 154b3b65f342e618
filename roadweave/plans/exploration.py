"""Exploration report over readings with exploration columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.lookups import is_rush_hour
from roadweave.functions.numeric import percent_of, rounded
from roadweave.operators.quantiles import quantiles

NUMERIC = [
    "current_speed", "free_flow_speed", "current_travel_time", "free_flow_travel_time", "confidence",
    "congestion_ratio", "speed_drop_pct", "delay_seconds", "hour",
]


def _rows() -> Column:
    return F.count(F.lit(1))


def _avg(column: str, digits: int = 2) -> Column:
    return rounded(F.avg(column), digits)


def _share_of_all(counted: DataFrame, digits: int) -> DataFrame:
    """Add ``pct`` of the total; the window runs over counts, one row per group."""
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("pct", rounded(F.col("count") * F.lit(100.0) / total, digits))


def low_confidence(readings: DataFrame, threshold: float = 0.5, count: int = 10) -> DataFrame:
    """The first readings (in time order) below the threshold."""
    return (
        readings.filter(F.col("confidence") < threshold)
        .select("location_name", "request_time", "current_speed", "confidence", "reading_id")
        .orderBy("request_time", "reading_id").limit(count).drop("reading_id")
    )


def low_confidence_share(readings: DataFrame, threshold: float = 0.5) -> DataFrame:
    low = F.col("confidence") < threshold
    return readings.agg(F.count_if(low).alias("low_confidence"), percent_of(low).alias("pct"))


def sanity_counts(readings: DataFrame) -> DataFrame:
    """Suspicious rows.  Duplicates are rows equal in every column, so they need one full grouping;
    the other checks ride along on it."""
    copies = readings.groupBy(*readings.columns).agg(_rows().alias("_copies"))

    def weight(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_copies"))), F.lit(0))

    return copies.agg(
        F.sum(F.col("_copies") - 1).alias("duplicate_rows"),
        weight(F.col("current_speed") < 0).alias("negative_speed"),
        weight(F.col("current_speed") > 150).alias("speed_over_150"),
        weight((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("confidence_out_of_range"),
        weight(F.col("congestion_ratio") > 1).alias("ratio_over_1"),
        weight(F.col("road_closure")).alias("road_closures"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percent per column, only columns that miss something; one scan."""
    counts = df.agg(_rows().alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot("_total", df.columns, "column_name", "missing")
        .filter(F.col("missing") > 0)
        .select("column_name", "missing", rounded(F.col("missing") * F.lit(100.0) / F.col("_total"), 2).alias("missing_pct"))
    )


def suspicious_counts(readings_with_previous: DataFrame) -> DataFrame:
    """Needs ``previous_speed`` (the road's reading before)."""
    speed, free_flow = F.col("current_speed"), F.col("free_flow_speed")
    return readings_with_previous.agg(
        F.count_if((speed == 0) & ~F.col("road_closure")).alias("zero_speed_open_road"),
        F.count_if(speed > free_flow).alias("faster_than_free_flow"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence"),
        F.count_if(F.col("previous_speed") - speed >= 40).alias("sudden_drop"),
    )


def dataset_profile(readings: DataFrame) -> DataFrame:
    """Span, size and the road classes present (a handful of values)."""
    return readings.agg(
        F.min("request_time").alias("first_time"), F.max("request_time").alias("last_time"),
        F.countDistinct("location_name").alias("roads"),
        F.sort_array(F.collect_set("frc")).alias("frc_values"),
        _rows().alias("rows"), F.lit(len(readings.columns)).alias("columns"))


def round_summary(rounds: DataFrame) -> DataFrame:
    """Per polling round (column ``round_start``): roads fetched, mean over non-zero speeds."""
    return rounds.groupBy("round_start").agg(
        _rows().alias("locations_fetched"),
        rounded(F.coalesce(F.avg(F.nullif("current_speed", F.lit(0.0))), F.lit(0.0)), 1).alias("avg_speed"))


def frc_breakdown(readings: DataFrame) -> DataFrame:
    return _share_of_all(readings.groupBy("frc", "road_type").agg(_rows().alias("count")), 1)


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Equal-width bins over each column's own range: rows per (column, bin 1..bins).

    The upper end belongs to the last bin.  Ranges and counts are two pre-aggregated passes.
    """
    ranges = df.agg(F.struct(*[
        F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c)
        for c in columns]).alias("ranges"))

    def bin_of(c):
        low, high = F.col(f"_ranges.{c}.low"), F.col(f"_ranges.{c}.high")
        place = F.when(high > low, F.floor((F.col(c) - low) * bins / F.nullif(high - low, F.lit(0.0))) + 1)
        return F.when(F.col(c).isNotNull(), F.least(F.lit(bins), F.coalesce(place, F.lit(1)))).alias(c)

    return (
        df.select(*columns).withColumn("_ranges", ranges.scalar())
        .select(*[bin_of(c) for c in columns])
        .unpivot([], columns, "column_name", "bin").filter(F.col("bin").isNotNull())
        .groupBy("column_name", "bin").agg(_rows().alias("count"))
    )


def speeds_by_road(readings: DataFrame) -> DataFrame:
    means = readings.groupBy("location_name").agg(
        _avg("current_speed", 1).alias("avg_speed"), _avg("free_flow_speed", 1).alias("avg_free_flow"))
    return means.withColumn("gap", rounded(F.col("avg_free_flow") - F.col("avg_speed"), 1)).orderBy("avg_speed")


def describe(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column.

    Moments come from one scan; the quartiles of all columns from one exact quantile run
    over the unpivoted values.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot([], columns, "column_name", "value")
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("count"), rounded(F.avg("value"), digits).alias("mean"),
        rounded(F.stddev_samp("value"), digits).alias("std"),
        rounded(F.min("value"), digits).alias("min"), rounded(F.max("value"), digits).alias("max"))
    quartiles = quantiles(long, ["column_name"], "value", [0.25, 0.5, 0.75])
    return moments.join(quartiles.select("column_name", "quantiles"), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min",
        *[rounded(F.get("quantiles", F.lit(i)), digits).alias(n) for i, n in enumerate(["p25", "p50", "p75"])], "max")


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, distinct values, most frequent value (ties to the smallest) and its frequency."""
    counted = (
        df.select(*columns).unpivot([], columns, "column_name", "value").filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(_rows().alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("order"), "value", "n"))
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("best")).select(
        "column_name", "count", "unique", F.col("best.value").alias("top"), F.col("best.n").alias("freq"))


def level_distribution(readings: DataFrame) -> DataFrame:
    """Readings per exploration class in the fixed class order."""
    counted = readings.groupBy("congestion_level").agg(_rows().alias("count"))
    position = F.array_position(F.array(*map(F.lit, fv.EDA_LEVELS)), F.col("congestion_level"))
    return _share_of_all(counted, 1).withColumn("position", position).orderBy("position")


def level_cross_tab(readings: DataFrame) -> DataFrame:
    """Share of each class within a road."""
    return readings.groupBy("location_name").agg(
        *[percent_of(F.col("congestion_level") == level, 2).alias(level) for level in fv.EDA_LEVELS])


def speed_by_hour(readings: DataFrame) -> DataFrame:
    return readings.groupBy("hour").agg(_avg("current_speed").alias("avg_speed")).withColumn(
        "is_rush", is_rush_hour(F.col("hour"))).orderBy("hour")


def rush_comparison(readings: DataFrame) -> DataFrame:
    """Four measures in and out of the rush hour and their difference; one scan."""
    rush = F.col("is_rush_hour") == "Rush hour"
    measures = {
        "avg_speed": lambda when: F.avg(F.when(when, F.col("current_speed"))),
        "avg_ratio": lambda when: F.avg(F.when(when, F.col("congestion_ratio"))),
        "avg_delay": lambda when: F.avg(F.when(when, F.col("delay_seconds"))),
        "road_closures": lambda when: F.count_if(when & F.col("road_closure")).cast("double"),
        "readings": lambda when: F.count_if(when).cast("double"),
    }
    both = readings.agg(*[
        F.struct(measure(rush).alias("rush"), measure(~rush).alias("off_peak")).alias(name)
        for name, measure in measures.items()])
    return both.unpivot([], list(measures), "metric", "v").select(
        "metric", rounded(F.col("v.rush"), 2).alias("rush_hour"), rounded(F.col("v.off_peak"), 2).alias("off_peak"),
        rounded(F.col("v.off_peak") - F.col("v.rush"), 2).alias("difference"))


def _road_measures() -> dict[str, Column]:
    return {
        "avg_speed": _avg("current_speed"),
        "avg_congestion": _avg("congestion_ratio"),
        "readings": F.count("current_speed"),
        "avg_delay_s": _avg("delay_seconds"),
        "road_closures": F.count_if("road_closure"),
    }


def road_summary(readings: DataFrame) -> DataFrame:
    extra = {
        "min_speed": rounded(F.min("current_speed"), 2), "max_speed": rounded(F.max("current_speed"), 2),
        "std_speed": rounded(F.stddev_samp("current_speed"), 2), "avg_confidence": _avg("confidence"),
    }
    return readings.groupBy("location_name").agg(
        *[m.alias(n) for n, m in {**_road_measures(), **extra}.items()]).orderBy("avg_congestion", "location_name")


def box_plot(readings: DataFrame) -> DataFrame:
    """Quartiles per road with 1.5 IQR fences, by median."""
    q = quantiles(readings, ["location_name"], "current_speed", [0.25, 0.5, 0.75])
    q1, q2, q3 = (F.get("quantiles", F.lit(i)) for i in range(3))
    return q.select(
        "location_name", rounded(q1, 2).alias("q1"), rounded(q2, 2).alias("median"), rounded(q3, 2).alias("q3"),
        rounded(q1 - 1.5 * (q3 - q1), 2).alias("low_fence"), rounded(q3 + 1.5 * (q3 - q1), 2).alias("high_fence"),
    ).orderBy("median", "location_name")


def map_summary(readings: DataFrame) -> DataFrame:
    return readings.groupBy("location_name", "requested_lat", "requested_lon").agg(
        *[m.alias(n) for n, m in _road_measures().items()])


def closure_rate(readings: DataFrame) -> DataFrame:
    return readings.groupBy("location_name").agg(
        F.count_if("road_closure").alias("closures"), F.count("road_closure").alias("readings"),
        rounded(F.count_if("road_closure") * F.lit(100.0) / F.nullif(F.count("road_closure"), F.lit(0)), 1).alias("pct"),
    ).orderBy("pct", "location_name")


def closure_share(readings: DataFrame) -> DataFrame:
    return readings.agg(F.count_if("road_closure").alias("closures"), _rows().alias("readings"),
                        percent_of(F.col("road_closure")).alias("pct"))


def correlations(readings: DataFrame, columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Pearson matrix in long form; each pair ignores only rows where one of *its* columns is NULL.

    Every reading is paired with each of its own values in turn, so one grouping by column
    name needs one correlation per column; all pairs in a single row would be too many
    aggregates for generated code.
    """
    columns = columns or NUMERIC
    values = readings.select(*[F.col(c).cast("double").alias(c) for c in columns])
    paired = values.withColumn("_a", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])))
    return (
        paired.groupBy(F.col("_a.name").alias("column_a"))
        .agg(*[rounded(F.corr("_a.value", c), digits).alias(c) for c in columns])
        .unpivot("column_a", columns, "column_b", "correlation")
    )


def ranked_correlations(readings: DataFrame, target: str = "current_speed") -> DataFrame:
    return (
        correlations(readings).filter((F.col("column_a") == target) & (F.col("column_b") != target))
        .select(F.col("column_b").alias("column_name"), "correlation")
        .orderBy(F.desc_nulls_last("correlation"), "column_name")
    )


def key_findings(readings: DataFrame) -> DataFrame:
    """Headline figures.  Everything is summed per road first, so the readings are read once."""
    def parts(name, column):
        return [F.sum(column).alias(f"{name}_s"), F.count(column).alias(f"{name}_c")]

    gap = F.col("free_flow_speed") - F.col("current_speed")
    roads = readings.groupBy("location_name").agg(
        _rows().alias("n"), rounded(F.avg("congestion_ratio"), 2).alias("ratio"),
        *parts("speed", F.col("current_speed")), *parts("free", F.col("free_flow_speed")),
        *parts("delay", F.col("delay_seconds")), *parts("gap", gap),
        F.count_if(F.col("congestion_level").isin("Heavy", "Severe")).alias("heavy"),
        F.count_if(F.col("confidence") < 0.5).alias("low"),
        F.count_if("road_closure").alias("closures"),
        F.count_if(F.col("current_speed").isNull()).alias("no_speed"),
        F.min("request_time").alias("first"), F.max("request_time").alias("last"),
    )

    def mean(name):
        return rounded(F.sum(f"{name}_s") / F.nullif(F.sum(f"{name}_c"), F.lit(0)), 1)

    def share(name):
        return rounded(F.sum(name) * F.lit(100.0) / F.sum("n"), 1)

    worst = F.min_by(F.struct("location_name", "ratio"), F.struct("ratio", "location_name"))
    best = F.min_by(F.struct("location_name", "ratio"), F.struct(-F.col("ratio"), F.col("location_name")))
    return roads.agg(
        F.sum("n").alias("readings"), F.count("location_name").alias("roads"),
        F.min("first").alias("first_time"), F.max("last").alias("last_time"),
        mean("speed").alias("avg_speed"), mean("free").alias("avg_free_flow"), mean("gap").alias("avg_speed_lost"),
        mean("delay").alias("avg_delay"), share("heavy").alias("heavy_or_severe_pct"),
        worst["location_name"].alias("most_congested"), worst["ratio"].alias("most_congested_ratio"),
        best["location_name"].alias("least_congested"), best["ratio"].alias("least_congested_ratio"),
        F.sum("closures").alias("closures"), share("low").alias("low_confidence_pct"),
        share("no_speed").alias("missing_speed_pct"),
    )


def timeline(readings: DataFrame) -> DataFrame:
    """Readings of every road in time order.  Range partitions by (road, time) split a hot road."""
    return (
        readings.select("location_name", "request_time", "current_speed", "congestion_ratio", "reading_id")
        .repartitionByRange("location_name", "request_time", "reading_id")
        .sortWithinPartitions("location_name", "request_time", "reading_id")
    )
