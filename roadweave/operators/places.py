"""Lookups of coordinates in tables of places: the nearest point, and the first rectangle that holds a point.

Points are sorted along a Z-order curve and cut into runs of equal length, runs of runs, and so on up to one run of all: a tree
that follows the points, however crowded they lie.  A lookup goes down this tree with the boxes of the runs and drops at each
step what cannot be the answer for any point of a run, so the work grows with the points and what is near them.  Equal
coordinates are looked up once and the answer is joined back to their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.geo import haversine_km
from roadweave.session import checkpoint_dir

RUN_BITS, PLACE_BITS = 6, 3
"""A run of the finest level holds at most two to this power of points, or of places."""
FAN_BITS = 3
"""Two to this power of runs make a run of the next level."""
CHUNK = 100
"""Places that are compared with the points of a run at once."""
SLACK, SLACK_ABS = 1e-9, 1e-12
"""More than the greatest error of a chord and of the formula that decides in the end."""


def _stored(df: DataFrame) -> DataFrame:
    """Written once below the shared folder: a position in sorted rows must not change when a task runs again."""
    path = f"{checkpoint_dir(df.sparkSession)}/places/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _finite(*columns: str) -> Column:
    """Neither NULL nor NaN nor infinite."""
    found = F.lit(True)
    for c in columns:
        found = found & (F.abs(F.col(c)) < float("inf"))
    return found


def _coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """The distinct coordinates; -0.0 is 0.0."""
    points = df.select((F.col(lat).cast("double") + 0.0).alias("_lat"), (F.col(lon).cast("double") + 0.0).alias("_lon"))
    return points.filter(_finite("_lat", "_lon")).distinct()


def _spread(value: Column) -> Column:
    """The 31 bits of a number, a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def _in_runs(points: DataFrame, lat: str, lon: str, bits: int) -> tuple[DataFrame, int]:
    """Points with the number ``_run`` of their run of the finest level, and the number of levels above it."""
    def steps(column: str, least: float, width: float) -> Column:
        return F.least(F.greatest((F.col(column) - least) / width, F.lit(0.0)) * 2**31, F.lit(2.0**31 - 1)).cast("long")

    curve = _spread(steps(lat, -90.0, 180.0)).bitwiseOR(F.shiftleft(_spread(steps(lon, -180.0, 360.0)), 1))
    row = F.monotonically_increasing_id()  # part of the sorted rows, and place in it
    placed = _stored(points.orderBy(curve, lat, lon).withColumns({"_part": F.shiftright(row, 33), "_at": F.shiftright(row.bitwiseAND(F.lit(2**33 - 1)), bits)}))
    most = placed.agg(F.max("_part").alias("part"), F.max("_at").alias("at")).first()
    width = int(most["at"] or 0).bit_length()
    levels = -(-(int(most["part"] or 0).bit_length() + width) // FAN_BITS)
    return placed.withColumn("_run", F.shiftleft("_part", width).bitwiseOR(F.col("_at"))).drop("_part", "_at"), levels


def _boxes(rows: DataFrame, columns: list[str], levels: int) -> DataFrame:
    """(level, run): least and greatest value of the columns in the runs of all levels; 0 is the finest."""
    bounds = [f(c).alias(f"{name}{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    finest = rows.groupBy("_run").agg(*bounds)
    return finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).groupBy(
        "level", F.expr(f"shiftright(_run, {FAN_BITS} * level)").alias("run")).agg(
        *[f(f"{name}{c}").alias(f"{name}{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]).checkpoint()


def _level(boxes: DataFrame, level: int, prefix: str) -> DataFrame:
    return boxes.filter(F.col("level") == level).drop("level").toDF(*[f"{prefix}{c}" for c in boxes.columns if c != "level"])


def _children(column: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(2**FAN_BITS - 1)), lambda i: F.shiftleft(column, FAN_BITS) + i))


def _numbered(table: DataFrame, order: str) -> DataFrame:
    """Rows with a number ``_n`` that grows with ``order``."""
    return _stored(table.orderBy(order).select(F.struct(*table.columns).alias("_row"), F.monotonically_increasing_id().alias("_n")))


def _back(df: DataFrame, found: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.join(found, (df[lat] == found["_lat"]) & (df[lon] == found["_lon"]), "left").drop("_lat", "_lon")


def _vector(lat: str, lon: str) -> dict[str, Column]:
    """Place on the unit sphere: chords there grow with the distance, and know no date line and no pole."""
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    return {"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}


def _nearer(pairs: DataFrame, of_points: DataFrame, of_places: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes p and q but those where another q is nearer to every point of p; ``_bound`` is how far the nearest is at most."""
    shortest, longest = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        apart = F.greatest(F.col(f"qleast{c}") - F.col(f"pmost{c}"), F.col(f"pleast{c}") - F.col(f"qmost{c}"), F.lit(0.0))
        across = F.greatest(F.col(f"qmost{c}") - F.col(f"pleast{c}"), F.col(f"pmost{c}") - F.col(f"qleast{c}"))
        shortest, longest = shortest + apart * apart, longest + across * across
    met = pairs.join(of_points, "prun").join(of_places, "qrun").select(
        "prun", "qrun", *more, "_bound", F.sqrt(shortest).alias("_shortest"), F.sqrt(longest).alias("_longest"))
    bound = F.min("_longest").over(Window.partitionBy("prun")) * (1 + SLACK) + SLACK_ABS
    # what holds for a box holds for the boxes in it
    met = met.filter("_shortest <= _bound").withColumn("_bound", F.least("_bound", bound))
    return met.filter("_shortest <= _bound").select("prun", "qrun", *more, "_bound")


def _closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each row's points and places, the pairs of a point and its nearest place by chord, or one that rounding keeps apart from it."""
    def vectors(lat, lon):
        phi, lam = np.radians(lat), np.radians(lon)
        return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], axis=-1)

    names = ["_lat", "_lon", "_n", "qlat", "qlon"]
    for batch in batches:
        found = []
        for lat, lon, n, q_lat, q_lon in batch.itertuples(index=False):
            chords = np.sqrt(np.square(vectors(lat, lon)[:, None] - vectors(q_lat, q_lon)[None]).sum(axis=-1))
            of, to = np.nonzero(chords <= chords.min(axis=1, keepdims=True) * (1 + SLACK) + SLACK_ABS)
            found.append((lat[of], lon[of], n[to], q_lat[to], q_lon[to]))
        yield pd.DataFrame({name: np.concatenate(parts) if parts else [] for name, parts in zip(names, zip(*found) if found else [()] * 5, strict=True)})


def _near(points: DataFrame, height: int, known: DataFrame, q_height: int) -> DataFrame:
    """(prun, _n, qlat, qlon): the places that may be the nearest of a point of a run."""
    known = known.withColumns(_vector("qlat", "qlon"))
    of_points, of_places = _boxes(points.withColumns(_vector("_lat", "_lon")), ["x", "y", "z"], height), _boxes(known, ["x", "y", "z"], q_height)
    p, q = height, q_height  # from one run of all points and one of all places
    pairs = points.sparkSession.range(1).select(F.lit(0).cast("long").alias("prun"), F.lit(0).cast("long").alias("qrun"), F.lit(float("inf")).alias("_bound"))
    while p or q:
        if q and q >= p - 1:  # runs of points hold more than runs of places do
            q, pairs = q - 1, pairs.withColumn("qrun", _children("qrun"))
        else:
            p, pairs = p - 1, pairs.withColumn("prun", _children("prun"))
        pairs = _nearer(pairs, _level(of_points, p, "p"), _level(of_places, q, "q")).checkpoint()
    places_ = known.select(F.col("_run").alias("qrun"), "_n", "qlat", "qlon", *[F.col(c).alias(f"q{e}{c}") for c in "xyz" for e in ("least", "most")])
    return _nearer(pairs, _level(of_points, 0, "p"), places_, ("_n", "qlat", "qlon"))


def nearest_place(df: DataFrame, places: DataFrame, lat: str, lon: str, order: str, output: str = "nearest") -> DataFrame:
    """Add ``output``: struct of the nearest place's columns and its ``km``; of equally near places the least ``order`` wins.

    ``places`` has ``lat``, ``lon`` and a unique ``order``.  Points and places are cut into runs, whose boxes on the sphere go down
    both trees in pairs: a run of places stays while it may hold the nearest place of a point in the run of points.  Each point is
    then compared with the few places left for its run.  Coordinates that are NULL or not finite, and an empty table of places, give NULL.
    """
    checkpoint_dir(df.sparkSession)
    numbered = _numbered(places, order)
    known = numbered.select("_n", *[F.col(f"_row.{c}").cast("double").alias(f"q{c}") for c in ("lat", "lon")]).filter(_finite("qlat", "qlon"))
    points, height = _in_runs(_coordinates(df, lat, lon), "_lat", "_lon", RUN_BITS)
    known, q_height = _in_runs(known, "qlat", "qlon", PLACE_BITS)
    near = _near(points, height, known, q_height)
    chunk = F.floor((F.row_number().over(Window.partitionBy("prun").orderBy("_n")) - 1) / CHUNK)
    near = near.withColumn("_chunk", chunk).groupBy(F.col("prun").alias("_run"), "_chunk").agg(
        *[F.collect_list(F.struct("_n", "qlat", "qlon"))[c].alias(c) for c in ("_n", "qlat", "qlon")])
    runs = points.groupBy("_run").agg(*[F.collect_list(F.struct("_lat", "_lon"))[c].alias(c) for c in ("_lat", "_lon")])
    compared = runs.join(near, "_run").select("_lat", "_lon", "_n", "qlat", "qlon").mapInPandas(
        _closest, "_lat double, _lon double, _n bigint, qlat double, qlon double")
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("qlat"), F.col("qlon"))
    compared = compared.select("_lat", "_lon", F.struct(km.alias("km"), "_n").alias("_best"))
    best = compared.groupBy("_lat", "_lon").agg(F.min("_best").alias("_best")).select("_lat", "_lon", "_best.km", "_best._n")
    answers = best.join(numbered, "_n").select("_lat", "_lon", F.struct("_row.*", "km").alias(output))
    return _back(df, answers, lat, lon)


def _looks(points: DataFrame, height: int, whole: DataFrame) -> DataFrame:
    """(_run, _n, sides): the rectangles of which one is the first to hold a point of a run; one that covers the run has no sides."""
    sides = ["south", "north", "west", "east"]
    boxes = _boxes(points, ["_lat", "_lon"], height)
    pairs = whole.select(F.lit(0).cast("long").alias("run"), "_n", *sides, F.lit(None).cast("long").alias("_first"))
    covers = []
    for level in range(height, -1, -1):
        met = pairs.join(_level(boxes, level, ""), "run").filter("south <= most_lat AND north >= least_lat AND west <= most_lon AND east >= least_lon")
        covering = F.expr("south <= least_lat AND north >= most_lat AND west <= least_lon AND east >= most_lon")
        met = met.select("run", "_n", *sides, "_first", covering.alias("_covers")).checkpoint()
        first = met.filter("_covers").groupBy("run").agg(F.min("_n").alias("_own"))
        covers.append(first.select(F.lit(level).alias("level"), "run", "_own"))
        cut = met.filter("NOT _covers").join(first, "run", "left").withColumn("_first", F.least("_first", "_own")).filter("_first IS NULL OR _n < _first")
        pairs = cut.select(_children("run").alias("run") if level else "run", "_n", *sides, "_first")
    covered = covers[0]
    for more in covers[1:]:
        covered = covered.unionByName(more)
    # the first covering rectangle of a run or of one above it holds every point of the run
    finest = boxes.filter("level = 0").select(F.col("run").alias("_run"), F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level")).withColumn(
        "run", F.expr(f"shiftright(_run, {FAN_BITS} * level)"))
    first = finest.join(covered, ["level", "run"]).groupBy("_run").agg(F.min("_own").alias("_n"))
    everything = {c: F.lit(float(f"{sign}inf")) for c, sign in zip(sides, "-+-+", strict=True)}
    return pairs.withColumnRenamed("run", "_run").select("_run", "_n", *sides).unionByName(first.withColumns(everything))


def first_rectangle(df: DataFrame, rectangles: DataFrame, lat: str, lon: str, order: str, output: str = "rectangle") -> DataFrame:
    """Add ``output``: struct of the columns of the first rectangle, by ``order``, that holds the point; borders belong to it.

    ``rectangles`` has ``south``, ``north``, ``west``, ``east`` and a unique ``order``.  Rectangles go down the runs of points:
    the first one that covers a run's box is the answer for its points unless an earlier one holds a part, so only earlier ones
    that cut the box go on to the runs within.  One with a NULL border, or turned around, holds nothing.
    """
    checkpoint_dir(df.sparkSession)
    sides = ["south", "north", "west", "east"]
    numbered = _numbered(rectangles.filter(F.col(order).isNotNull()), order)
    whole = numbered.select("_n", *[F.col(f"_row.{c}").cast("double").alias(c) for c in sides]).filter("south <= north AND west <= east")
    points, height = _in_runs(_coordinates(df, lat, lon), "_lat", "_lon", RUN_BITS)
    held = points.join(_looks(points, height, whole), "_run").filter("_lat BETWEEN south AND north AND _lon BETWEEN west AND east")
    found = held.groupBy("_lat", "_lon").agg(F.min("_n").alias("_n"))
    return _back(df, found.join(numbered, "_n").select("_lat", "_lon", F.col("_row").alias(output)), lat, lon)
