"""Distances and district lookup.

The lookups add columns in steps (unit vector, squared chords to the known points, position
of the smallest), because each step is used several times by the next one.  Everything stays
a projection: the known points are constants of the plan, so there is no join and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * fv.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def district_by_box(lat: str, lon: str) -> Column:
    """First rectangle (in declared order) containing the point, NULL when there is none."""
    cases = " ".join(
        f"WHEN {lat} BETWEEN {south}D AND {north}D AND {lon} BETWEEN {west}D AND {east}D THEN '{name}'"
        for name, south, north, west, east in fv.DISTRICT_BOXES)
    return F.expr(f"CASE {cases} END")


def with_nearest_point(df: DataFrame, lat: str, lon: str, output: str = "nearest") -> DataFrame:
    """Add the 0-based position of the closest known point (NULL without coordinates).

    The chord through the sphere grows with the great-circle distance, so comparing squared
    chords finds the same point without a trigonometric function per point.  The first listed
    of equally near points wins.
    """
    # without coordinates the vector is zero rather than NULL: the 25 formulas below then need
    # no NULL handling, which keeps the generated method small enough to be compiled
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    vector = {"_x": F.cos(phi) * F.cos(lam), "_y": F.cos(phi) * F.sin(lam), "_z": F.sin(phi)}
    chords = []
    for _, p_lat, p_lon, _ in fv.KNOWN_POINTS:
        p, q = math.radians(p_lat), math.radians(p_lon)
        offsets = (f"(_x - {math.cos(p) * math.cos(q)}D)", f"(_y - {math.cos(p) * math.sin(q)}D)", f"(_z - {math.sin(p)}D)")
        chords.append(" + ".join(f"{d} * {d}" for d in offsets))
    closest = F.array_position("_chords", F.array_min("_chords")).cast("int") - 1
    return (
        df.withColumns({name: F.coalesce(value, F.lit(0.0)) for name, value in vector.items()})
        .withColumn("_chords", F.expr(f"array({', '.join(chords)})"))
        .withColumn(output, F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), closest))
        .drop("_x", "_y", "_z", "_chords")
    )


def point_value(position: Column, field: int) -> Column:
    """Field of the known point at a position: 0 name, 1 latitude, 2 longitude, 3 district."""
    values = ", ".join(f"'{p[field]}'" if isinstance(p[field], str) else f"{p[field]}D" for p in fv.KNOWN_POINTS)
    return F.get(F.expr(f"array({values})"), position)


def with_district(df: DataFrame, lat: str = "requested_lat", lon: str = "requested_lon",
                  output: str = "district") -> DataFrame:
    """Rectangle first; outside every rectangle, or far from the city, the nearest known point.

    Filter on the result only after something that keeps the filter from being pushed down
    (an aggregate, a stored table): pushed into the scan it would repeat the formulas.
    """
    south, north, west, east = fv.METRO_AREA
    in_metro = F.col(lat).between(south, north) & F.col(lon).between(west, east)
    return (
        with_nearest_point(df, lat, lon, "_nearest")
        .withColumn(output, F.coalesce(
            F.when(in_metro, district_by_box(lat, lon)), point_value(F.col("_nearest"), 3)))
        .drop("_nearest")
    )


def with_message_district(df: DataFrame, given: str = "district", place: str = "_place") -> DataFrame:
    """``district``: named by the message, else from non-zero coordinates, else ``Unknown``.

    A column ``place`` that already holds the district of the coordinates is used and kept.
    """
    named = F.nullif(F.col(given), F.lit("")) if given in df.columns else F.lit(None).cast("string")
    usable = (F.coalesce("requested_lat", F.lit(0.0)) != 0) & (F.coalesce("requested_lon", F.lit(0.0)) != 0)
    placed = df if place in df.columns else with_district(df, output=place)
    found = placed.withColumn("district", F.coalesce(named, F.when(usable, F.col(place)), F.lit("Unknown")))
    return found if place in df.columns else found.drop(place)
