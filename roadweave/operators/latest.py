"""Newest row per key, newest rows overall, newest N per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], newest_by: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``newest_by`` tuple.

    A ``max_by`` aggregate, so each task keeps one candidate per key before anything is
    shuffled and a hot key costs no more than a cold one.  End ``newest_by`` with a unique
    column to make the choice reproducible.
    """
    keep = columns or [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*keep), F.struct(*newest_by)).alias("newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def newest_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Sort with a limit: every task sends only its own best ``limit`` rows."""
    return df.orderBy(*order).limit(limit)


def recent_per_key(df: DataFrame, keys: list[str], newest_by: list[str], count: int) -> DataFrame:
    """The newest ``count`` rows of every key, with ``recency`` 1 = newest.

    The rank filter is applied before the shuffle as well (window group limit), so a task
    ships at most ``count`` rows per key.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest_by])
    return df.withColumn("recency", F.row_number().over(window)).filter(F.col("recency") <= count)


def since(column: str, as_of: Column, hours: float) -> Column:
    """``column > as_of - hours``, strict, written so that it reaches the scan as a filter."""
    return F.col(column) > as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")


def previous_period(column: str, as_of: Column, hours: float) -> Column:
    """The period of the same length before ``since``: ``(as_of - 2h, as_of - h]``."""
    return since(column, as_of, 2 * hours) & ~since(column, as_of, hours)
