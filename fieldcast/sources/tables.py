"""Parquet tables: read, and append only what a table lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.operators.dedup import new_rows
from fieldcast.session import stored

_S, _D = T.StringType(), T.DoubleType()
CHECKLISTS = T.StructType([
    T.StructField("sub_id", _S), T.StructField("loc_id", _S), T.StructField("region", _S),
    T.StructField("obs_dt", _S), T.StructField("obs_date", T.DateType()),
    T.StructField("obs_time", _S), T.StructField("duration_hrs", _D),
    T.StructField("distance_km", _D), T.StructField("n_observers", T.IntegerType()),
    T.StructField("protocol_id", _S), T.StructField("all_reported", T.BooleanType()),
    T.StructField("richness", T.IntegerType()), T.StructField("observer", _S),
    T.StructField("scraped_at", T.TimestampType()),
])
OBSERVATIONS = T.StructType([
    T.StructField("sub_id", _S), T.StructField("species_code", _S),
    T.StructField("how_many", T.IntegerType()),
])
LOCATIONS = T.StructType([
    T.StructField("loc_id", _S), T.StructField("lat", _D), T.StructField("lon", _D),
    T.StructField("is_hotspot", T.BooleanType()),
])


#: the partition column of appended tables, and how many numbered ids share a value
KEY_RANGE, IDS = "key_range", 1 << 20
#: ids without a number at their end are dealt to this many ranges by hash
UNNUMBERED = 64


def key_range(key: Column, ids: int = IDS) -> Column:
    """Where a row is stored: a range of ids.

    Ids are given out in order, so what is new falls into the newest ranges and a
    re-filed row into its own old one, whatever date it names this time.
    """
    number = F.regexp_extract(key.cast("string"), r"(\d+)$", 1).try_cast("long")
    return F.coalesce(F.floor(number / F.lit(ids)).cast("long"),
                      F.pmod(F.xxhash64(key), F.lit(UNNUMBERED)) - UNNUMBERED)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table, or an empty one when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def known_keys(path: str, rows: DataFrame, keys: Sequence[str], ids: int = IDS) -> DataFrame:
    """The stored keys that ``rows`` could meet: only the key columns, and only of
    the ranges that the rows' first key falls into. Other partitions are not read,
    however long the table has grown. ``rows`` should be stored or cached."""
    touched = [r[0] for r in rows.select(key_range(F.col(keys[0]), ids)).distinct().collect()]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(KEY_RANGE, T.LongType())])
    stored_ = read_table(rows.sparkSession, path, schema)
    return stored_.where(F.col(KEY_RANGE).isin(touched)).select(*keys)


def append(rows: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (),
           ids: int = IDS) -> None:
    """Append rows that are known to be new, in the layout ``known_keys`` reads."""
    parts = [*partition_by, KEY_RANGE]
    # one writer per partition and hash slice: neither many small files nor one
    # task for a busy range
    (rows.withColumn(KEY_RANGE, key_range(F.col(keys[0]), ids))
     .repartition(*parts, F.pmod(F.xxhash64(*keys), F.lit(4)))
     .write.mode("append").partitionBy(*parts).parquet(path))


def append_new(incoming: DataFrame, path: str, keys: Sequence[str],
               partition_by: Sequence[str] = (), ids: int = IDS) -> None:
    """Append the rows of ``incoming`` whose key the table at ``path`` lacks.

    A null key fails the job: it would never match and be appended each time.
    Safe to repeat: the second run of the same batch appends nothing. Parquet
    appends commit all files of a job at the end, so a failed job leaves the
    table as it was. The batch is written once, since its ranges are needed before
    it is compared; of the table only the keys of those ranges are read.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    incoming = stored(incoming.where(F.when(whole, True).otherwise(
        F.raise_error(F.lit(f"null key among {', '.join(keys)}")).cast("boolean"))), "incoming")
    append(new_rows(known_keys(path, incoming, keys, ids), incoming, keys), path, keys, partition_by, ids)
