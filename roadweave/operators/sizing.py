"""Size checks behind every broadcast, and the short list of hot keys behind every salt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
HOT_PARTS = 512


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side really is small.

    Needed for *aggregated* sides, whose size Spark cannot know when it plans the join:
    without the hint the big side is shuffled before the runtime re-plan can help.  Tables
    read from files or built from fixed lists need no hint, their size is known to the planner.
    Larger sides keep the plain shuffle join, where skewed partitions are split at run time.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(df: DataFrame, keys: list[str], parts: int = HOT_PARTS) -> DataFrame:
    """Keys holding more than ``1/parts`` of all rows, with the number of salts they need.

    Fewer than ``parts`` keys can exceed that share, whatever the data: the result is safe
    to broadcast by construction.  One pre-aggregated pass over the key columns only.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows"))
    return (
        counts.filter(F.col("rows") * parts > total.scalar())
        .select(*keys, F.ceil(F.col("rows") * parts / total.scalar()).cast("int").alias("salts"))
    )


def salt_of(identity: Column, salts: Column) -> Column:
    """Reproducible salt in ``[0, salts)``: the same row gets the same salt in a retried task."""
    return F.pmod(F.xxhash64(identity), salts).cast("int")
