"""Answers about a place that its neighbours share until they expire.

A question is asked at exact coordinates and answered for the rounded ones, so
all that round alike share an answer. Answers are kept as an append-only table;
a round only computes those places that asked and have none that still holds.
Each place-round is a header row, so a place where nothing was seen is answered
too, and does not ask again before it expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import params as P
from fieldcast.operators.dedup import top_by
from fieldcast.operators.spatial import recent_around, rounded
from fieldcast.session import stored
from fieldcast.sources.tables import read_table

_D = T.DoubleType()
HEADERS = T.StructType([T.StructField("blat", _D), T.StructField("blon", _D),
                        T.StructField("answered_on", T.DateType())])
ANSWERS = T.StructType([*HEADERS.fields, T.StructField("species_code", T.StringType()),
                        T.StructField("last_seen", T.DateType()), T.StructField("n_lists", T.LongType())])


def _places(points: DataFrame, decimals: int) -> DataFrame:
    return points.select("point_id", rounded("lat", decimals).alias("blat"),
                         rounded("lon", decimals).alias("blon"))


def holding(store: DataFrame, as_of: str, days: int) -> DataFrame:
    """The newest header of each place, if it is at most ``days`` old on ``as_of``."""
    age = F.datediff(F.lit(as_of).cast("date"), "answered_on")
    live = store.where(age.between(0, days))
    return top_by(live, ["blat", "blon"], [F.col("answered_on").desc()], 1)


def ask_recent(points: DataFrame, sightings: DataFrame, root: str, as_of: str,
               days: int = P.ANSWER_DAYS, radius_km: float = P.NEARBY_KM, back_days: int = 14,
               decimals: int = 1) -> DataFrame:
    """point_id, species_code, last_seen, n_lists and answered_on of every point.

    ``root`` holds the shared answers; places without one that still holds on
    ``as_of`` are answered now and kept. Answers are written before their headers,
    so a round that fails half-way is asked again and nothing is read twice: rows
    are found by their header's date, and those of one date are told apart.
    """
    spark = points.sparkSession
    asked = _places(points, decimals)
    here = asked.select("blat", "blon").where("blat is not null and blon is not null").distinct()
    known = holding(read_table(spark, f"{root}/headers", HEADERS), as_of, days)
    open_ = stored(here.join(known, ["blat", "blon"], "left_anti"), "open-places")
    day = F.lit(as_of).cast("date").alias("answered_on")
    ask = open_.select(F.concat_ws(":", "blat", "blon").alias("point_id"), "blat", "blon",
                       F.col("blat").alias("lat"), F.col("blon").alias("lon"))
    fresh = recent_around(sightings, ask.select("point_id", "lat", "lon"), as_of, radius_km, back_days, decimals)
    (fresh.join(ask.select("point_id", "blat", "blon"), "point_id")
     .select("blat", "blon", day, "species_code", "last_seen", F.col("n_lists").cast("long").alias("n_lists"))
     .write.mode("append").parquet(f"{root}/answers"))
    open_.select("blat", "blon", day).write.mode("append").parquet(f"{root}/headers")
    known = holding(read_table(spark, f"{root}/headers", HEADERS), as_of, days)
    rows = read_table(spark, f"{root}/answers", ANSWERS).dropDuplicates(
        ["blat", "blon", "answered_on", "species_code"])
    return (asked.join(known, ["blat", "blon"]).join(rows, ["blat", "blon", "answered_on"])
            .select("point_id", "species_code", "last_seen", "n_lists", "answered_on"))
