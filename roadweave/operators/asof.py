"""As-of join: each left row takes the newest right row at or before it, within a tolerance.

Time is cut into slots.  A slot holds its left rows, its right rows and one carry row per
series (the newest right row of the slots before it that the tolerance can still reach), so
slots are independent and the work is one linear sort per slot.  Slots that hold a large
share of the left rows are salted and their right rows repeated for every salt.  Right rows
are reduced to one per instant first, so what is repeated is bounded by the length of a slot
and the resolution of the clock, not by the size of the right side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.sizing import hot_keys, salt_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    left_id: str,
    right_ts: str,
    right_id: str,
    columns: list[str],
    tolerance_seconds: int,
    by: list[str] | None = None,
    slot_seconds: int = 60,
) -> DataFrame:
    """Left rows plus ``columns`` of the matched right row (NULL without a match).

    ``by`` are equality keys both sides share (empty: one series for everybody).
    """
    by = by or []
    key = [*by, "_slot"]
    reach = math.ceil(tolerance_seconds / slot_seconds)

    def slot(column):
        return F.floor(F.unix_seconds(F.col(column)) / slot_seconds)

    lefts = left.withColumn("_slot", slot(left_ts))
    values = F.struct(F.col(right_ts).alias("_right_at"), *columns)
    rights = (
        right.withColumn("_slot", slot(right_ts))
        .groupBy(*key, F.col(right_ts).alias("_at")).agg(F.max_by(values, F.col(right_id)).alias("_right"))
        .withColumn("_kind", F.lit(1))
    )
    last_of_slot = rights.groupBy(*key).agg(F.max_by(F.struct("_at", "_right"), F.col("_at")).alias("_last"))
    carried = (
        last_of_slot
        .withColumn("_slot", F.explode(F.sequence(F.col("_slot") + 1, F.col("_slot") + reach)))
        .groupBy(*key)
        .agg(F.max_by("_last", F.col("_last._at")).alias("_last"))
        .select(*key, "_last._at", F.lit(0).alias("_kind"), "_last._right")
    )
    hot = F.broadcast(hot_keys(lefts.select(*key), key))
    salted_lefts = (
        lefts.join(hot, key, "left")
        .withColumn("_salt", F.coalesce(salt_of(F.col(left_id), F.col("salts")), F.lit(0)))
    )
    salted_rights = (
        rights.unionByName(carried)
        .join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    )
    stacked = (
        salted_lefts.select(
            *key, "_salt", F.col(left_ts).alias("_at"), F.lit(2).alias("_kind"),
            F.struct(*left.columns).alias("_left"))
        .unionByName(salted_rights.select(*key, "_salt", "_at", "_kind", "_right"),
                     allowMissingColumns=True)
    )
    window = (
        Window.partitionBy(*key, "_salt").orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = F.last("_right", ignorenulls=True).over(window)
    fresh = (F.unix_micros(F.col("_at")) - F.unix_micros("_found._right_at")) <= tolerance_seconds * 1_000_000
    return (
        stacked.withColumn("_found", found)
        .filter(F.col("_kind") == 2)
        .select("_left.*", *[F.when(fresh, F.col(f"_found.{c}")).alias(c) for c in columns])
    )
