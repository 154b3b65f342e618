"""Nearest match inside a coordinate band, through grid cells instead of a theta join.

Where many events lie at different coordinates of one cell, the cell is quartered, and its quarters again, until each
holds few (a quadtree made from counts). A place then goes down the tree: of the cells it still looks at it drops those
whose box of events is farther than an event already known, so it meets few cells of a level and few events at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.session import checkpoint_dir

MOST_IN_CELL = 2_000
DEEPEST = 24  # quarterings of a cell, beyond which it is left as it is


def _down(level: int | Column, column: str, radius: float) -> Column:
    """Cell of a coordinate at a level; halving is exact, so cells of a level lie inside those of the one above."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.floor(F.col(column) / F.lit(radius) * F.pow(F.lit(2.0), level))


def _crowded(spots: DataFrame, radius: float, most: int) -> tuple[DataFrame, int]:
    """The spots, stored if a cell is crowded, and the level at which no cell holds more than ``most`` of them."""
    level = 0
    while level < DEEPEST:
        counts = spots.groupBy(_down(level, "event_lat", radius), _down(level, "event_lon", radius)).count()
        if counts.filter(F.col("count") > most).isEmpty():
            break
        if not level:
            checkpoint_dir(spots.sparkSession)
            spots = spots.checkpoint()
        level += 1
    return spots, level


def _tree(spots: DataFrame, radius: float, depth: int) -> DataFrame:
    """Cells of all levels: number of spots, their box, and one of them."""
    finest = spots.groupBy(_down(depth, "event_lat", radius).alias("cell_y"), _down(depth, "event_lon", radius).alias("cell_x")).agg(
        F.count(F.lit(1)).alias("spots"), F.min("event_lat").alias("south"), F.max("event_lat").alias("north"),
        F.min("event_lon").alias("west"), F.max("event_lon").alias("east"), F.min(F.struct("event_lat", "event_lon")).alias("known"))
    up = f"{depth} - level"
    return (
        finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .groupBy("level", F.expr(f"shiftright(cell_y, {up})").alias("cell_y"), F.expr(f"shiftright(cell_x, {up})").alias("cell_x")).agg(
            F.sum("spots").alias("spots"), F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"),
            F.max("east").alias("east"), F.min("known").alias("known"))
    )


def _descended(around: DataFrame, spots: DataFrame, radius: float, most: int, depth: int) -> DataFrame:
    """(lat, lon, spot): what is left to compare once a place has gone down the tree."""
    tree = _tree(spots, radius, depth).checkpoint()
    whole = F.col("spots") <= most  # not quartered

    def closer(looks: DataFrame) -> DataFrame:
        """Drop cells out of the band, and cells farther than an event known to a place."""
        beside = F.greatest(F.col("south") - F.col("lat"), F.col("lat") - F.col("north"), F.lit(0.0))
        across = F.greatest(F.col("west") - F.col("lon"), F.col("lon") - F.col("east"), F.lit(0.0))
        y, x = F.abs(F.col("known.event_lat") - F.col("lat")), F.abs(F.col("known.event_lon") - F.col("lon"))
        bound = F.least("bound", F.min(F.when((y < radius) & (x < radius), y + x)).over(Window.partitionBy("lat", "lon")))
        return looks.filter((beside < radius) & (across < radius)).withColumn("bound", bound).filter(
            F.col("bound").isNull() | (beside + across <= F.col("bound")))

    kept = ["lat", "lon", "bound", "level", "cell_y", "cell_x", "spots"]
    looks = closer(around.withColumns({"level": F.lit(0), "bound": F.lit(None).cast("double")}).join(tree, ["level", "cell_y", "cell_x"])).select(kept).checkpoint()
    ended = looks.filter(whole | (F.col("level") == depth))
    for _ in range(depth):
        quarters = (
            looks.filter(~whole).drop("spots").withColumn("level", F.col("level") + 1)
            .withColumn("cell_y", F.explode(F.array(F.col("cell_y") * 2, F.col("cell_y") * 2 + 1)))
            .withColumn("cell_x", F.explode(F.array(F.col("cell_x") * 2, F.col("cell_x") * 2 + 1)))
        )
        looks = closer(quarters.join(tree, ["level", "cell_y", "cell_x"])).select(kept).checkpoint()
        ended = ended.unionByName(looks.filter(whole | (F.col("level") == depth)))
    leaf = tree.filter(whole | (F.col("level") == depth)).select("level", "cell_y", "cell_x", "spots")
    above = leaf.select((F.col("level") + 1).alias("level"), "cell_y", "cell_x", F.lit(True).alias("inside"))
    top = leaf.withColumns({"up_y": F.shiftright("cell_y", 1), "up_x": F.shiftright("cell_x", 1)}).join(
        above.select("level", F.col("cell_y").alias("up_y"), F.col("cell_x").alias("up_x"), "inside"), ["level", "up_y", "up_x"], "left_anti")
    placed = (
        spots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .withColumns({"cell_y": _down(F.col("level"), "event_lat", radius), "cell_x": _down(F.col("level"), "event_lon", radius)})
        .join(top.select("level", "cell_y", "cell_x"), ["level", "cell_y", "cell_x"])
    )
    return ended.select("lat", "lon", "level", "cell_y", "cell_x").join(placed, ["level", "cell_y", "cell_x"])


def nearest_in_band(
    places: DataFrame,
    events: DataFrame,
    place_key: str,
    event_order: list[str],
    radius: float = fv.INCIDENT_RADIUS_DEG,
    most: int = MOST_IN_CELL,
) -> DataFrame:
    """For every place the event with the smallest L1 distance, both offsets below ``radius``.

    Both sides carry ``lat`` and ``lon``; ``event_order`` breaks ties between equally near
    events (smallest first) and must be unique.  Only the winner per exact event coordinate
    takes part, since events on one spot differ for no place, and places on one spot share
    their answer; so a crowded spot costs no more than any other.  A spot looks into the nine
    cells around it, and candidates fold into a running minimum instead of being kept.  Cells with
    more than ``most`` spots are quartered (see above); the spots are then checkpointed.
    """

    def cell(column):
        return _down(0, column, radius)

    rest = [c for c in events.columns if c not in ("lat", "lon")]
    spots = (
        events.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("lat", "lon")
        .agg(F.min_by(F.struct(*rest), F.struct(*event_order)).alias("event"))
        .select(F.col("lat").alias("event_lat"), F.col("lon").alias("event_lon"), "event")
    )
    located = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(place_key, "lat", "lon")
    around = (
        located.select("lat", "lon").distinct()
        .withColumns({"cell_y": F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)), "x": cell("lon")})
        .withColumn("cell_x", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)))
    )
    spots, depth = _crowded(spots, radius, most)
    if depth:
        pairs = _descended(around.drop("x"), spots, radius, most, depth)
    else:
        pairs = around.join(spots.withColumns({"cell_y": cell("event_lat"), "cell_x": cell("event_lon")}), ["cell_y", "cell_x"])
    off_y, off_x = F.abs(F.col("event_lat") - F.col("lat")), F.abs(F.col("event_lon") - F.col("lon"))
    order = [F.col(f"event.{c}") for c in event_order]
    nearest = (
        pairs
        .filter((off_y < radius) & (off_x < radius))
        .withColumn("distance", off_y + off_x)
        .groupBy("lat", "lon")
        .agg(F.min_by(F.struct("event", "event_lat", "event_lon", "distance"),
                      F.struct("distance", *order)).alias("best"))
    )
    return located.join(nearest, ["lat", "lon"]).select(
        "best.event.*", F.col("best.event_lat").alias("lat"), F.col("best.event_lon").alias("lon"),
        F.col(place_key).alias("near_road"), F.col("best.distance").alias("distance"))
