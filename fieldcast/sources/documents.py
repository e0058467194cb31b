"""Landed JSON documents to rows. Schemas are explicit, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.operators.dedup import keep_first

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Field names of the landed documents.
CHECKLIST_DOC = _struct(
    subId=_S, locId=_S, obsDt=_S, durationHrs=_D, effortDistanceKm=_D, numObservers=_I,
    protocolId=_S, allObsReported=_B, userDisplayName=_S,
    obs=T.ArrayType(_struct(speciesCode=_S, howManyAtleast=_I, howManyAtmost=_I)))
FEED_DOC = T.ArrayType(_struct(
    subId=_S, loc=_struct(locId=_S, latitude=_D, longitude=_D, isHotspot=_B)))
HOURLY_FIELDS = {
    "temperature_2m": "temp", "precipitation": "precip", "wind_speed_10m": "wind",
    "cloud_cover": "cloud", "relative_humidity_2m": "humid", "pressure_msl": "pressure",
}
DAILY_FIELDS = {
    "wind_speed_10m_max": "wind_max", "precipitation_sum": "precip",
    "temperature_2m_mean": "temp_mean",
}


def _arrays(fields) -> T.StructType:
    return _struct(time=T.ArrayType(_S), **{f: T.ArrayType(_D) for f in fields})


HOURLY_DOC = _struct(hourly=_arrays(HOURLY_FIELDS))
DAILY_DOC = _struct(daily=_arrays(DAILY_FIELDS))


def parse(df: DataFrame, column: str, schema: T.DataType) -> DataFrame:
    return df.withColumn("doc", F.from_json(F.col(column), schema))


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def checklist_rows(docs: DataFrame, region: str, scraped_at: Column | None = None) -> DataFrame:
    """One row per document (column ``doc``), text before the first space of
    the date-time being the date. Richness counts every record, coded or not.
    ``scraped_at`` is when the document was fetched, null when not known."""
    scraped_at = F.lit(None) if scraped_at is None else scraped_at
    dt = F.coalesce("doc.obsDt", F.lit(""))
    at = F.locate(" ", dt)
    date = F.when(at > 0, F.substring(dt, F.lit(1), at - 1)).otherwise(dt)
    time = F.when(at > 0, F.substring(dt, at + 1, F.length(dt)))
    return docs.select(
        F.col("doc.subId").alias("sub_id"), F.col("doc.locId").alias("loc_id"),
        F.lit(region).alias("region"), dt.alias("obs_dt"),
        F.try_to_date(_or_null(date)).alias("obs_date"), _or_null(time).alias("obs_time"),
        F.col("doc.durationHrs").alias("duration_hrs"),
        F.col("doc.effortDistanceKm").alias("distance_km"),
        F.col("doc.numObservers").alias("n_observers"),
        F.col("doc.protocolId").alias("protocol_id"),
        F.col("doc.allObsReported").alias("all_reported"),
        F.greatest(F.size("doc.obs"), F.lit(0)).alias("richness"),
        F.col("doc.userDisplayName").alias("observer"),
        scraped_at.cast("timestamp").alias("scraped_at"))


def observation_rows(docs: DataFrame) -> DataFrame:
    """One row per coded record. A lower count of 0 means unknown, so the upper
    count is used instead."""
    o = docs.select(F.col("doc.subId").alias("sub_id"), F.explode("doc.obs").alias("o"))
    return (o.where(F.col("o.speciesCode").isNotNull() & (F.col("o.speciesCode") != ""))
            .select("sub_id", F.col("o.speciesCode").alias("species_code"),
                    F.coalesce(F.nullif("o.howManyAtleast", F.lit(0)), "o.howManyAtmost")
                    .alias("how_many")))


def feed_locations(feeds: DataFrame, order: Sequence[str] = ("day",)) -> DataFrame:
    """Sites of the day feeds (column ``doc``); the first one seen wins.

    Feeds count in the given column order, entries by their place in the feed.
    """
    items = feeds.select(*order, F.posexplode("doc").alias("pos", "item")).select(
        *order, "pos", "item.loc.*")
    rows = items.where(F.col("locId").isNotNull() & (F.col("locId") != "")).select(
        *order, "pos", F.col("locId").alias("loc_id"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.coalesce("isHotspot", F.lit(False)).alias("is_hotspot"))
    return keep_first(rows, ["loc_id"], [*map(F.col, order), F.col("pos")]).drop(*order, "pos")


def weather_unzip(docs: DataFrame, keys: list[str], block: str = "hourly") -> DataFrame:
    """Parallel arrays under ``doc.<block>`` to one row per time.

    ``keys`` are carried along, for example the cell the document is for.
    """
    fields = HOURLY_FIELDS if block == "hourly" else DAILY_FIELDS
    # a document may lack a whole variable; its values are then null
    absent = F.array().cast("array<double>")
    zipped = F.arrays_zip(F.col(f"doc.{block}.time").alias("time"),
                          *[F.coalesce(f"doc.{block}.{c}", absent).alias(c) for c in fields])
    rows = docs.select(*keys, F.inline(zipped))
    time = (F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz").alias("ts")
            if block == "hourly" else F.try_to_date("time").alias("date"))
    return rows.select(*keys, time, *[F.col(f).alias(n) for f, n in fields.items()])
