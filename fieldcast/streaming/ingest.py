"""Incremental ingest of landed checklist documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldcast import params as P
from fieldcast.operators.dedup import keep_first
from fieldcast.sources.documents import CHECKLIST_DOC, checklist_rows, observation_rows
from fieldcast.sources.tables import IDS, append, append_new, known_keys


def document_stream(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed JSON-lines files as a stream with the document in ``doc``, what
    could not be parsed in ``raw``, and when the file landed."""
    schema = T.StructType([*CHECKLIST_DOC.fields, T.StructField("_raw", T.StringType())])
    return (spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "_raw")
            .option("maxFilesPerTrigger", files_per_trigger).json(landing)
            .select(F.struct(*CHECKLIST_DOC.fieldNames()).alias("doc"), F.col("_raw").alias("raw"),
                    F.col("_metadata.file_modification_time").alias("landed"),
                    F.col("_metadata.file_path").alias("file")))


def whole(batch: DataFrame) -> DataFrame:
    """Documents that name an outing, with its id."""
    good = batch.where(F.col("raw").isNull() & F.col("doc.subId").isNotNull())
    return good.withColumn("sub_id", F.col("doc.subId"))


def usable(batch: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One document per outing that is not ``known``, the first that landed. What is known
    goes first: only new documents are compared with each other."""
    good = whole(batch)
    if known is not None:
        good = good.join(known, "sub_id", "left_anti")
    return keep_first(good, ["sub_id"], [F.col("landed"), F.col("file"), F.to_json("doc")])


def rejects(batch: DataFrame) -> DataFrame:
    """Documents that are broken or name no outing, as text."""
    bad = batch.where(F.col("raw").isNotNull() | F.col("doc.subId").isNull())
    return bad.select(F.coalesce("raw", F.to_json("doc")).alias("document"), "file")


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str, region: str,
           files_per_trigger: int = 1000, ids: int = IDS) -> StreamingQuery:
    """Run all landed files into ``store``, then stop. Call again to resume.

    Overlapping days are read again freely: a stored outing is skipped with all
    its observations, however it was filed again. Broken documents go to
    ``store/rejects``. Of the stored keys only the id ranges of a batch are read, once
    per table (``sources/tables.py``). A batch replayed after a failure therefore adds nothing twice, and
    the stream's checkpoint makes a long backfill resumable per batch.
    """
    def sink(batch: DataFrame, _epoch: int) -> None:
        # parsed once
        landed = batch.persist()
        known = known_keys(f"{store}/checklists", whole(landed), ["sub_id"], ids)
        docs = usable(landed, known).persist()
        try:
            append_new(rejects(landed), f"{store}/rejects", ["file", "document"])
            # observations first: a stored outing always has its observations
            append_new(observation_rows(docs), f"{store}/observations",
                       ["sub_id", "species_code"], ids=ids)
            # no document of these is stored, and there is one per outing
            append(checklist_rows(docs, region, F.col("landed")), f"{store}/checklists", ["sub_id"], ids=ids)
        finally:
            docs.unpersist()
            landed.unpersist()

    return (document_stream(spark, landing, files_per_trigger).writeStream
            .foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def settled_stream(docs: DataFrame, region: str, lag_days: int = P.LAG_DAYS) -> DataFrame:
    """Outings per day as a stream, given out once the day has settled.

    The watermark trails the newest outing by ``lag_days``; a day's count
    appears when the watermark passes its end. An outing filed again counts once:
    its id stays in the state store until the watermark has passed it by the lag,
    and what is filed for a day the watermark has reached is dropped. Both states
    are bounded by the lag, whatever the stream's age. The batch rule in
    ``settled_window`` never reads unsettled days instead.
    """
    rows = checklist_rows(docs.where("raw is null and doc.subId is not null"), region).withColumn(
        "obs_ts", F.col("obs_date").cast("timestamp"))
    return (rows.select("sub_id", "obs_ts").withWatermark("obs_ts", f"{lag_days} days")
            .dropDuplicatesWithinWatermark(["sub_id"])
            .groupBy(F.window("obs_ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").cast("date").alias("obs_date"), "n"))


def settle(spark: SparkSession, landing: str, settled: str, checkpoint: str, region: str,
           lag_days: int = P.LAG_DAYS, files_per_trigger: int = 1000) -> StreamingQuery:
    """Take in what has landed, append the days that settled, then stop.

    Called again after the next filing wave it goes on where it stopped: watermark
    and open days come from the checkpoint. A replayed batch gives the same days,
    and the file sink's log lets each of them appear once.
    """
    docs = document_stream(spark, landing, files_per_trigger)
    return (settled_stream(docs, region, lag_days).writeStream.format("parquet").outputMode("append")
            .option("path", settled).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
