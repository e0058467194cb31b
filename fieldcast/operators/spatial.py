"""Nearest sites by descent through grid cubes, and sites within a radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import haversine_km
from fieldcast.functions.place import chord_km, cube, cube_distances, position
from fieldcast.operators.dedup import top_by
from fieldcast.session import stored


def _around(c: Column) -> Column:
    """The cube and its 26 neighbours."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return F.flatten(F.transform(steps, lambda dx: F.flatten(F.transform(
        steps, lambda dy: F.transform(steps, lambda dz: F.struct(
            (c["x"] + dx).alias("x"), (c["y"] + dy).alias("y"), (c["z"] + dz).alias("z")))))))


#: a cube is parted into this many along each axis, at most so often, until none
#: holds more than so many sites
SPLIT, LEVELS, FULL = 4, 10, 32
#: kilometres that distances may be off by
SLACK = 1e-6


def _depth(sites: DataFrame, radius_km: float, full: int) -> int:
    """How many levels part the densest cube down to ``full`` sites."""
    own = F.array(*[F.struct(F.lit(i).alias("level"), cube(
        F.col("latitude"), F.col("longitude"), radius_km / SPLIT ** i).alias("cube")) for i in range(LEVELS)])
    most = (sites.select(F.inline(own)).groupBy("level", "cube").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("level").agg(F.max("n").alias("n")).collect())  # a row per level
    return 1 + min((r["level"] for r in most if r["n"] <= full), default=LEVELS - 1)


def candidates(places: DataFrame, sites: DataFrame, k: int, radius_km: float) -> DataFrame:
    """lat, lon, loc_id and the site's coordinates: what can be among the ``k``
    nearest within the radius, by descent through a hierarchy of cubes.

    On every level a place knows some cubes with their numbers of sites. Taken by
    their farthest points, the cubes that together hold ``k`` sites bound the
    distance of the ``k``-th; cubes whose nearest point lies beyond are dropped, the
    others parted. Only what is left on the finest level is met site by site, so a
    lone place beside a dense town meets the town's edge, not the town. ``places``
    and ``sites`` are distinct and have coordinates.
    """
    # of sites on one spot the first k by name will do
    few = stored(top_by(sites, ["latitude", "longitude"], [F.col("loc_id")], k), "sites")
    levels = _depth(few, radius_km, max(FULL, 2 * k))
    side = [radius_km / SPLIT ** i for i in range(levels)]
    at = position(F.col("lat"), F.col("lon"))
    parent = lambda c: F.struct(*[F.floor(c[a] / SPLIT).alias(a) for a in ("x", "y", "z")])
    finest = few.withColumn("cube", cube(F.col("latitude"), F.col("longitude"), side[-1]))
    counts = [finest.groupBy("cube").agg(F.count(F.lit(1)).alias("n"))]
    for _ in range(levels - 1):
        up = counts[0].groupBy(parent(F.col("cube")).alias("cube")).agg(F.sum("n").alias("n"))
        counts.insert(0, up)
    known = places.withColumn("cube", F.explode(_around(cube(F.col("lat"), F.col("lon"), side[0]))))
    by_far = Window.partitionBy("lat", "lon").orderBy("far", "cube")
    for i, cells in enumerate(counts):
        if i:
            known = (known.withColumnRenamed("cube", "parent")
                     .join(cells.withColumn("parent", parent(F.col("cube"))), "parent"))
        else:
            known = known.join(cells, "cube")
        near, far = cube_distances(at, F.col("cube"), side[i])
        known = known.select("lat", "lon", "cube", "n", near.alias("near"), far.alias("far")).where(
            F.col("near") <= chord_km(radius_km) + SLACK)
        # the farthest point of the cubes that hold k sites between them
        upto = F.sum("n").over(by_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        bound = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(Window.partitionBy("lat", "lon"))
        known = (known.withColumn("upto", upto).withColumn("bound", bound)
                 .where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") + SLACK))
                 .select("lat", "lon", "cube"))
    return known.join(finest.select("cube", "loc_id", "latitude", "longitude"), "cube").drop("cube")


def nearest_sites(points: DataFrame, sites: DataFrame, k: int, radius_km: float) -> DataFrame:
    """The ``k`` nearest sites within ``radius_km`` of each point.

    ``points`` has point_id, lat, lon; ``sites`` has loc_id, latitude,
    longitude. Points sharing coordinates are searched once.
    """
    places = points.select("lat", "lon").where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    s = sites.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "loc_id", "latitude", "longitude")
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    pairs = (candidates(places, s, k, radius_km).withColumn("distance_km", d)
             .where(F.col("distance_km") <= radius_km))
    near = top_by(pairs, ["lat", "lon"], [F.round("distance_km", 9), F.col("loc_id")], k, "rank")
    return (points.join(near.select("lat", "lon", "loc_id", "distance_km", "rank"),
                        ["lat", "lon"], "inner"))


def snap_hotspot(points: DataFrame, hotspots: DataFrame, radius_km: float = P.SITE_SNAP_KM
                 ) -> DataFrame:
    """The nearest hotspot within reach of each point; null when there is none."""
    near = nearest_sites(points, hotspots, 1, radius_km).select("point_id", "loc_id", "distance_km")
    return points.join(near, "point_id", "left")


def nearby_ranked(points: DataFrame, hotspots: DataFrame, best: DataFrame, k: int = 10,
                  radius_km: float = P.NEARBY_KM) -> DataFrame:
    """The ``k`` nearest hotspots of each point, ranked by best probability.

    ``points`` names the species asked for. ``best`` has species_code, loc_id,
    best_probability and has_site_effect. A site without a score is listed last.
    """
    near = nearest_sites(points, hotspots, k, radius_km).select(
        "point_id", "species_code", "loc_id", "distance_km")
    ranked = near.join(best, ["species_code", "loc_id"], "left")
    return top_by(ranked, ["point_id"],
                  [F.round("best_probability", 9).desc_nulls_last(), F.col("loc_id")], k, "position")


def rounded(column: str, decimals: int) -> Column:
    scale = F.lit(float(10 ** decimals))
    return F.rint(F.col(column) * scale) / scale


def _recent(sightings: DataFrame, as_of: str, back_days: int) -> DataFrame:
    end = F.lit(as_of).cast("date")
    return sightings.where(F.col("obs_date").between(F.date_sub(end, back_days), end))


def recent_nearby(sightings: DataFrame, as_of: str, back_days: int = 14, decimals: int = 1
                  ) -> DataFrame:
    """Species seen lately per rounded coordinate bucket, with the last date.

    ``sightings`` has sub_id, species_code, lat, lon, obs_date.
    """
    return (_recent(sightings, as_of, back_days)
            .groupBy(rounded("lat", decimals).alias("blat"),
                     rounded("lon", decimals).alias("blon"), "species_code")
            .agg(F.max("obs_date").alias("last_seen"), F.count(F.lit(1)).alias("n_lists")))


def recent_around(sightings: DataFrame, points: DataFrame, as_of: str,
                  radius_km: float = P.NEARBY_KM, back_days: int = 14, decimals: int = 1
                  ) -> DataFrame:
    """Species seen lately within a radius of each point's rounded coordinates.

    Points that round to the same place share one answer, so the search runs
    once per place however many points it has. Sightings are first combined per
    exact coordinate and species: a busy site meets a place once per species.
    """
    seen = (_recent(sightings, as_of, back_days).groupBy("lat", "lon", "species_code")
            .agg(F.max("obs_date").alias("last_seen"), F.count(F.lit(1)).alias("n_lists"))
            .withColumn("cube", cube(F.col("lat"), F.col("lon"), radius_km)))
    points = (points.withColumn("blat", rounded("lat", decimals))
              .withColumn("blon", rounded("lon", decimals)))
    places = points.select("blat", "blon").where(
        F.col("blat").isNotNull() & F.col("blon").isNotNull()).distinct().withColumn(
        "cube", F.explode(_around(cube(F.col("blat"), F.col("blon"), radius_km))))
    d = haversine_km(F.col("blat"), F.col("blon"), F.col("lat"), F.col("lon"))
    answers = (places.join(seen, "cube", "inner").where(d <= radius_km)
               .groupBy("blat", "blon", "species_code")
               .agg(F.max("last_seen").alias("last_seen"), F.sum("n_lists").alias("n_lists")))
    return (points.select("point_id", "blat", "blon").join(answers, ["blat", "blon"], "inner")
            .drop("blat", "blon"))
