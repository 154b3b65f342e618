"""Exact interpolated quantiles of large groups, whatever their range.

``percentile`` keeps every distinct value of a group in one task.  Here each group's own least and greatest value are cut
into a fixed number of bins, the bins that hold the wanted ranks are found by their counts, and only these are cut again,
between the least and the greatest value they hold, until each holds a single value.  Every pass is one aggregate of
the values inside the bins that are left; no task ever sorts more rows than a group has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.session import checkpoint_dir

LARGEST = 1.7976931348623157e308


def _bin(bins: int) -> Column:
    """Place of ``_v`` between ``_lo`` and ``_hi``: 0 to bins - 1, infinite values on their own outside.

    The greatest and the least value never share a bin, so each pass makes an interval smaller.
    """
    # halves, as the span of doubles is no double
    v, lo, hi = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) / 2 for c in ("_v", "_lo", "_hi"))
    inside = F.least(F.floor(F.try_divide(v - lo, hi - lo) * (bins - 1)), F.lit(bins - 1))
    return (
        F.when(F.col("_v") == F.lit(float("inf")), F.lit(bins)).when(F.col("_v") == F.lit(float("-inf")), F.lit(-1))
        .when(F.col("_v") == F.col("_hi"), F.lit(bins - 1)).otherwise(F.coalesce(inside, F.lit(0))).cast("long")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 1024) -> DataFrame:
    """One row per key: ``keys``, ``n`` and an array ``quantiles`` in the order of ``probs``.

    Linear interpolation between the two neighbouring values; NULL and NaN are ignored.  The counts of the values and the
    intervals left after each pass are checkpointed.
    """
    checkpoint_dir(df.sparkSession)
    named = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)] or [F.lit(0).alias("_k0")], F.col(value).cast("double").alias("_v"))
    # 0.0 and -0.0 are one value
    counted = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_v", F.col("_v") + 0.0).groupBy(*named, "_v").agg(
        F.count(F.lit(1)).alias("_c")).checkpoint()
    # 0-based ranks below and above every wanted position
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in probs])))
    whole = counted.groupBy(*named).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    left = whole.select(*named, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), ranks.alias("_ranks"))
    found, interval = [], ["_n", "_lo", "_hi", "_before"]
    while True:
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in named]
        inside = counted.alias("r").join(left.alias("i"), [*same, F.col("r._v").between(F.col("i._lo"), F.col("i._hi"))]).select(
            *[f"r.{k}" for k in named], "r._v", "r._c", *[f"i.{c}" for c in interval], "i._ranks")
        held = inside.groupBy(*named, *interval, _bin(bins).alias("_bin")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_ranks").alias("_ranks"))
        upto = F.sum("_c").over(Window.partitionBy(*named, *interval).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        start = F.col("_before") + F.coalesce(upto, F.lit(0))
        cut = held.withColumn("_start", start).withColumn(
            "_ranks", F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c")))).filter(F.size("_ranks") > 0).select(
            *named, "_n", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_start").alias("_before"), "_ranks").checkpoint()
        found.append(cut.filter("_lo = _hi"))
        left = cut.filter("_lo < _hi")
        if left.isEmpty():
            break
    single = found[0]
    for more in found[1:]:
        single = single.unionByName(more)
    picked = single.select(*named, "_n", F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v")).groupBy(*named, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def interpolated(p):
        position = (F.col("_n") - 1) * p
        low, high = F.try_element_at("_at", F.floor(position)), F.try_element_at("_at", F.ceil(position))
        # equal neighbours as they are, infinite ones too
        return F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))

    return picked.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], F.col("_n").alias("n"),
                         F.array(*[interpolated(p) for p in probs]).alias("quantiles"))
