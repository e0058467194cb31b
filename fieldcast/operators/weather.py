"""Hourly gridded weather: coverage, deduplication and the span join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions import hour_index
from fieldcast.operators.dedup import keep_first

CELL = ("clat", "clon")
GATED = ("wind_max", "temp_mean", "cloud_mean", "humid_mean")


def weather_dedup(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both batches, one row per (cell, hour); the new batch wins."""
    both = (cached.withColumn("_batch", F.lit(0))
            .unionByName(new.withColumn("_batch", F.lit(1))))
    return keep_first(both, [*CELL, "ts"], [F.col("_batch").desc()]).drop("_batch")


def weather_gap(outings: DataFrame, weather: DataFrame) -> DataFrame:
    """(cell, date) pairs that outings need and the weather table lacks.

    An outing may run past midnight, so each also needs the following day.
    Pairs are made distinct before the second day is added, which halves what
    the explode produces.
    """
    days = outings.select(*CELL, "obs_date").distinct()
    need = days.select(*CELL, F.explode(F.array("obs_date", F.date_add("obs_date", 1)))
                       .alias("date")).distinct()
    have = weather.select(*CELL, F.col("ts").cast("date").alias("date")).distinct()
    return need.join(have, [*CELL, "date"], "left_anti")


def gap_ranges(gap: DataFrame) -> DataFrame:
    """One fetch per cell over the first to last missing date."""
    return gap.groupBy(*CELL).agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"),
                                  F.count(F.lit(1)).alias("n_days"))


def span_aggregates(prefix: str = "w") -> list[Column]:
    """Max wind, total rain, mean temperature, cloud and humidity, hour count.

    The total over no rows is 0 while the others are null; the hour count and
    the gate tell the two apart.
    """
    c = lambda name: F.col(f"{prefix}.{name}")
    return [F.max(c("wind")).alias("wind_max"),
            F.coalesce(F.sum(c("precip")), F.lit(0.0)).alias("precip_sum"),
            F.avg(c("temp")).alias("temp_mean"),
            F.avg(c("cloud")).alias("cloud_mean"),
            F.avg(c("humid")).alias("humid_mean"),
            F.count(c("ts")).alias("n_wx_hours")]


def span_weather(spans: DataFrame, weather: DataFrame) -> DataFrame:
    """Aggregates for distinct (cell, first hour, last hour) spans."""
    keys = [*CELL, "h_lo", "h_hi"]
    hours = spans.select(*keys, F.explode(F.sequence("h_lo", "h_hi")).alias("h"))
    hourly = weather.withColumn("h", hour_index(F.col("ts"))).alias("w")
    return (hours.alias("s").join(hourly, [*CELL, "h"], "left")
            .groupBy(*keys).agg(*span_aggregates()))


def with_weather(outings: DataFrame, weather: DataFrame) -> DataFrame:
    """Each outing with the weather of all hours it touches, in its own cell.

    Weather depends on (cell, first hour, last hour) only, so the hour
    expansion runs on the distinct spans. A busy cell on a busy morning
    collapses to one row on the map side, and outings themselves move once,
    in the final lookup.
    """
    keys = [*CELL, "h_lo", "h_hi"]
    spans = outings.select(*keys).where(F.col("h_lo").isNotNull()).distinct()
    return (outings.join(span_weather(spans, weather), keys, "left")
            .withColumn("precip_sum", F.coalesce("precip_sum", F.lit(0.0)))
            .withColumn("n_wx_hours", F.coalesce("n_wx_hours", F.lit(0)).cast("long")))


def lacks_weather(columns: Sequence[str] = GATED) -> Column:
    """True where any gated value is null or no hour matched."""
    bad = F.col("n_wx_hours") == 0
    for c in columns:
        bad = bad | F.col(c).isNull()
    return bad


def weather_gate(table: DataFrame, columns: Sequence[str] = GATED) -> DataFrame:
    """Outings without full weather, counted per date."""
    return (table.where(lacks_weather(columns)).groupBy("obs_date")
            .agg(F.count(F.lit(1)).alias("n_bad")))


def require_weather(table: DataFrame, columns: Sequence[str] = GATED) -> DataFrame:
    """Fail the job on the first outing without weather instead of training on
    an invented dry day."""
    msg = F.concat(F.lit("no weather for outing "), F.col("sub_id"), F.lit(" on "),
                   F.col("obs_date").cast("string"))
    return table.withColumn(
        "n_wx_hours", F.when(lacks_weather(columns), F.raise_error(msg).cast("long"))
        .otherwise(F.col("n_wx_hours")))


def weather_spread(table: DataFrame,
                   columns: Sequence[str] = ("wind_max", "temp_mean", "precip_sum", "cloud_mean"),
                   ) -> DataFrame:
    """Min, median and max of each weather column.

    The median comes from distributed ranks, not from the built-in exact
    percentile, which would hold every distinct value in one task.
    """
    from fieldcast.operators.ranks import quantiles

    long = table.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns
    ])).alias("v")).select("v.*").where(F.col("x").isNotNull())
    ends = long.groupBy("variable").agg(F.min("x").alias("min_value"), F.max("x").alias("max_value"))
    mid = (quantiles(long, ["variable"], "x", 2)
           .where(F.col("k") == 1).select("variable", F.col("value").alias("median_value")))
    return ends.join(mid, "variable", "left")
