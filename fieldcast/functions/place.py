"""Distances and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcast.params import EARTH_KM, EXTENT


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / F.lit(2.0)), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / F.lit(2.0)), 2))
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lat: Column, lon: Column, extent: dict[str, float] = EXTENT) -> Column:
    """Inside the covered rectangle, edges included."""
    return (lat.between(extent["lat_min"], extent["lat_max"])
            & lon.between(extent["lon_min"], extent["lon_max"]))


def cube(lat: Column, lon: Column, side_km: float) -> Column:
    """Grid cube of a point on the sphere, as a struct of three integers.

    Two points within ``side_km`` of each other are in the same or in touching
    cubes, at any latitude and across the date line: the straight chord is
    never longer than the arc.
    """
    r = F.lit(EARTH_KM / side_km)
    x = r * F.cos(F.radians(lat)) * F.cos(F.radians(lon))
    y = r * F.cos(F.radians(lat)) * F.sin(F.radians(lon))
    z = r * F.sin(F.radians(lat))
    return F.struct(F.floor(x).alias("x"), F.floor(y).alias("y"), F.floor(z).alias("z"))


def chord_km(arc_km: float) -> float:
    """The straight line under an arc on the sphere; both order distances alike."""
    return 2.0 * EARTH_KM * math.sin(min(arc_km / (2.0 * EARTH_KM), math.pi / 2))


def position(lat: Column, lon: Column) -> Column:
    """A point on the sphere in kilometres from its centre."""
    r = F.lit(EARTH_KM)
    return F.struct((r * F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"),
                    (r * F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"),
                    (r * F.sin(F.radians(lat))).alias("z"))


def cube_distances(at: Column, c: Column, side_km: float) -> tuple[Column, Column]:
    """Shortest and longest straight line from a position to a point of a cube."""
    side, zero = F.lit(side_km), F.lit(0.0)
    near, far = zero, zero
    for axis in ("x", "y", "z"):
        lo = c[axis] * side
        before, behind = lo - at[axis], at[axis] - lo - side
        near = near + F.pow(F.greatest(before, behind, zero), 2)
        far = far + F.pow(F.greatest(F.abs(before), F.abs(behind)), 2)
    return F.sqrt(near), F.sqrt(far)
