"""Rounding that gives the same digits everywhere.

Rounding a raw double is sensitive to its binary tail (0.145 is slightly below 0.145).
Going through a six-digit decimal first removes that tail and any noise from the order
in which a distributed sum was added up, so results do not depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_decimal(value: Column, digits: int) -> Column:
    return value.cast("decimal(18,6)").cast(f"decimal(18,{digits})")


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding to ``digits`` decimals, returned as double."""
    return as_decimal(value, digits).cast("double")


def rounded_int(value: Column) -> Column:
    return as_decimal(value, 0).cast("bigint")


def rounded_text(value: Column, digits: int) -> Column:
    """Text with exactly ``digits`` decimals."""
    return as_decimal(value, digits).cast("string")


def safe_ratio(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    """``part / whole`` where ``whole > 0``, else ``default``."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(default).cast("double"))


def percent_of(condition: Column, digits: int = 1) -> Column:
    """Share of rows (aggregate) for which ``condition`` holds, in percent."""
    return rounded(F.count_if(condition) * F.lit(100.0) / F.count(F.lit(1)), digits)
