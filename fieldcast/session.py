"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SHUFFLE = "spark.sql.shuffle.partitions"


def build_session(app: str = "fieldcast", master: str | None = None,
                  shuffle_partitions: int | None = None, initial_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution set up for skewed joins.

    ``shuffle_partitions`` is for local runs. On a cluster ``initial_partitions``
    is the number adaptive execution coalesces from, about the largest shuffle
    over the memory a task may use; Spark's own 200 would mean huge partitions
    there, so a cluster session without either number is refused.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         # no Python call site per column: plans here hold hundreds of columns
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # rows expand about a hundredfold after an exchange (a site's week of
         # slots), so small shuffles must still keep every core busy
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
         # split a hot partition even where that costs one more exchange
         .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if initial_partitions:
        b = b.config(INITIAL, str(initial_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    named = spark.conf.get(INITIAL, None) or spark.sparkContext.getConf().get(SHUFFLE, None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("give initial_partitions: the largest shuffle over a task's memory")
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """The number of partitions a shuffle starts with."""
    return int(spark.conf.get(INITIAL, None) or spark.conf.get(SHUFFLE))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldcast-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table of this run under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder, read back as a columnar table.

    Cuts the lineage: a lost executor costs a re-read, not a recompute. Unlike
    a checkpoint, the table has exact size statistics, so the planner knows
    whether it may broadcast it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once its session's executors can import this package.

    Functions that run in tasks refer to their modules. The sources go out once per
    application, as a zip file over Spark's own file server.
    """
    sc = df.sparkSession.sparkContext
    name = "fieldcast-sources.zip"
    if not any(f.endswith(name) for f in sc.listFiles):
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="fieldcast-"), name)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
    return df
