"""Row lags over long per-key series.

A window over the key alone would put a key's whole history into one task.  Here a row is
first given its position in the series: time is cut into slots (a day, but a minute where one
key's day holds very many rows), the rows of a slot are numbered on their own and
shifted by the rows of the slots before.  Then the series is cut into equal chunks by position
and the last rows of a chunk are copied into the next one.  The lags are exactly those of the
uncut series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_ROWS = 1_000_000
HOT_SLOTS = 8192


def with_position(df: DataFrame, keys: list[str], ts: str, tie: str, slot: str = "day",
                  fine_slot: str = "minute", most: int = SLOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Add ``position``: 1, 2, 3 ... in time order within the key.  Rows without a key are left out.

    Rows are counted once by key and fine slot.  Slots of more than ``most`` rows (and of more than
    ``1/HOT_SLOTS`` of all, so that they are few) are cut into fine slots; a fine slot is not cut further.  The counts
    of all slots, and the rows before each, come from that small table.  Where ``df`` is costly to compute,
    ``counted`` names a cheaper table with the same rows as far as ``keys`` and ``ts`` are concerned.
    """
    counted = df if counted is None else counted
    fine = counted.groupBy(*keys, F.date_trunc(fine_slot, F.col(ts)).alias("_fine")).agg(F.count(F.lit(1)).alias("_rows"))
    coarse = fine.withColumn("_slot", F.date_trunc(slot, F.col("_fine")))
    sums = coarse.groupBy(*keys, "_slot").agg(F.sum("_rows").alias("_rows"))
    limit = F.greatest(F.lit(most), sums.agg(F.sum("_rows")).scalar() / HOT_SLOTS)
    hot = F.broadcast(sums.filter(F.col("_rows") > limit).select(*keys, "_slot", F.lit(True).alias("_hot")))

    def sliced(frame: DataFrame, fine_start: Column) -> DataFrame:
        return (
            frame.join(hot, [*keys, "_slot"], "left")
            .withColumn("_slot", F.when(F.col("_hot"), fine_start).otherwise(F.col("_slot"))).drop("_hot")
        )

    counts = sliced(coarse, F.col("_fine")).groupBy(*keys, "_slot").agg(F.sum("_rows").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts, tie)
    return (
        sliced(df.withColumn("_slot", F.date_trunc(slot, F.col(ts))), F.date_trunc(fine_slot, F.col(ts)))
        .join(offsets, [*keys, "_slot"])
        .withColumn("position", F.col("_before") + F.row_number().over(inside))
        .drop("_slot", "_before")
    )


def with_lags(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    lags: dict[str, tuple[str, int]],
    slot: str = "day",
    chunk_rows: int = 100_000,
    counted: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """Add ``position`` and one column per ``name -> (column, rows back)``.

    Negative ``rows back`` looks ahead.  ``placed`` rows have their ``position`` already, without gaps within the key but
    from any number on; they are not counted and moved again for it.
    """
    back = max([n for _, n in lags.values() if n > 0], default=0)
    ahead = max([-n for _, n in lags.values() if n < 0], default=0)
    if max(back, ahead) >= chunk_rows:
        raise ValueError("chunk_rows must exceed the deepest lag")
    index = F.col("position") - 1
    chunk = F.floor(index / chunk_rows)
    inside = index % chunk_rows
    homes = F.array_compact(F.array(
        chunk,
        F.when(inside >= chunk_rows - back, chunk + 1),
        F.when(inside < ahead, chunk - 1),
    ))
    spread = (
        (df if placed else with_position(df, keys, ts, tie, slot, counted=counted))
        .withColumns({"_home": chunk, "_homes": homes})
        .withColumn("_chunk", F.explode("_homes"))
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy("position")
    return (
        spread.withColumns({name: F.lag(column, n).over(window) for name, (column, n) in lags.items()})
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_home", "_homes", "_chunk")
    )
