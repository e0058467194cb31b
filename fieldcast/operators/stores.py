"""Stored tables: append by key, merge, census, sites and calendar gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldcast import params as P
from fieldcast.functions import week_of
from fieldcast.operators.dedup import new_rows
from fieldcast.sources.tables import append_new, read_table

# The columns that identify a row of each stored table.
TABLE_KEYS = {"checklists": ("sub_id",), "locations": ("loc_id",),
              "observations": ("sub_id", "species_code")}


class ColumnMismatch(ValueError):
    """The two sides of a merge hold different columns."""


def check_columns(name: str, left: DataFrame, right: DataFrame) -> None:
    only_left = sorted(set(left.columns) - set(right.columns))
    only_right = sorted(set(right.columns) - set(left.columns))
    if only_left or only_right:
        raise ColumnMismatch(f"{name}: only local {only_left}, only incoming {only_right}")


def merge_new(local: DataFrame, incoming: DataFrame, keys: Sequence[str],
              name: str = "table") -> DataFrame:
    """Rows of ``incoming`` that ``local`` lacks, in local column order.

    Columns are matched by name; differing column sets are an error.
    """
    check_columns(name, local, incoming)
    return new_rows(local, incoming.select(*local.columns), keys)


def merge_by_key(local: DataFrame, incoming: DataFrame, keys: Sequence[str],
                 name: str = "table") -> DataFrame:
    """Both sides together; a row already present is left alone."""
    return local.unionByName(merge_new(local, incoming, keys, name))


def merge_report(name: str, local: DataFrame, incoming: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """Rows seen, added and already known, as one row."""
    seen = incoming.select(*keys).distinct()
    flagged = seen.join(local.select(*keys, F.lit(True).alias("_known")).distinct(),
                        list(keys), "left")
    return flagged.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("n_seen"),
        F.count_if(F.col("_known").isNull()).alias("n_added"),
        F.count_if(F.col("_known").isNotNull()).alias("n_known"))


def merge_stores(local: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each stored table with the rows that only the incoming store has.

    A table that the incoming store lacks is left as it is.
    """
    return {t: merge_by_key(df, incoming[t], TABLE_KEYS[t], t) if t in incoming else df
            for t, df in local.items()}


def merge_stores_report(local: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> DataFrame:
    """One row per table of the incoming store: keys seen, added and known."""
    reports = [merge_report(t, df, incoming[t], TABLE_KEYS[t]) for t, df in local.items()
               if t in incoming]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def insert_sites(found: DataFrame, path: str) -> DataFrame:
    """Append the sites that the table at ``path`` lacks; how many were new or known.

    The report is taken before the rows land, so a replay reports nothing new.
    """
    known = read_table(found.sparkSession, path, found.schema)
    row = merge_report("locations", known, found, ["loc_id"]).first()
    append_new(found, path, ["loc_id"])
    return found.sparkSession.createDataFrame([row])


def table_census(checklists: DataFrame, observations: DataFrame) -> DataFrame:
    """Rows per table, distinct species and distinct sites, one row each."""
    def one(df: DataFrame, name: str, agg: Column) -> DataFrame:
        return df.agg(agg.cast("long").alias("n")).select(F.lit(name).alias("item"), "n")

    return (one(checklists, "checklists", F.count(F.lit(1)))
            .unionByName(one(observations, "observations", F.count(F.lit(1))))
            .unionByName(one(observations, "species", F.countDistinct("species_code")))
            .unionByName(one(checklists, "locations", F.countDistinct("loc_id"))))


def require_rows(census: DataFrame, item: str = "checklists") -> DataFrame:
    """Fail the job when a table that must not be empty is."""
    return census.withColumn("n", F.when(
        (F.col("item") == item) & (F.col("n") == 0),
        F.raise_error(F.lit(f"stored zero {item}")).cast("long")).otherwise(F.col("n")))


def unresolved_days(checklists: DataFrame, locations: DataFrame) -> DataFrame:
    """Days that hold a site without coordinates.

    (site, day) pairs are made distinct first, so a busy site is one row per
    day and task before the anti-join moves it.
    """
    pairs = checklists.select("loc_id", "obs_date").distinct()
    return (pairs.join(locations.select("loc_id"), "loc_id", "left_anti")
            .select("obs_date").distinct())


def site_census(checklists: DataFrame, locations: DataFrame) -> DataFrame:
    """Sites resolved, needed and missing; hotspot share; extent; span in km."""
    needed = checklists.select("loc_id").distinct()
    known = locations.select("loc_id").distinct()
    need = needed.join(known.withColumn("_known", F.lit(True)), "loc_id", "left").agg(
        F.struct(F.count(F.lit(1)).alias("n_needed"),
                 F.count_if(F.col("_known").isNull()).alias("n_missing"))).scalar()
    placed = F.col("lat").isNotNull()
    have = locations.agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if("is_hotspot").alias("n_hotspots"),
        F.min(F.when(placed, F.col("lat"))).alias("lat_min"),
        F.max(F.when(placed, F.col("lat"))).alias("lat_max"),
        F.min(F.when(placed, F.col("lon"))).alias("lon_min"),
        F.max(F.when(placed, F.col("lon"))).alias("lon_max"))
    span = (F.col("lat_max") - F.col("lat_min")) * F.lit(111.0)
    return (have.withColumn("need", need).select("*", "need.n_needed", "need.n_missing").drop("need")
            .withColumn("hotspot_share",
                        F.try_divide(F.col("n_hotspots").cast("double"), F.col("n_sites")))
            .withColumn("span_km", span)
            .withColumn("wider_than_cell", span > F.lit(25.0)))


def truncated_days(checklists: DataFrame, cap: int = P.FEED_CAP) -> DataFrame:
    """Outings per day, flagged when the feed's cap was reached."""
    return (checklists.groupBy("obs_date").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("truncated", F.col("n") >= cap))


def calendar(spark, start: str, end: str, as_of: str | None = None,
             lag_days: int = P.LAG_DAYS) -> DataFrame:
    """All dates from start to end, trimmed to what has settled by ``as_of``."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    if as_of:
        last = F.least(last, F.date_sub(F.lit(as_of).cast("date"), lag_days))
    days = F.when(last >= first, F.sequence(first, last))
    return spark.range(1).select(F.explode(days).alias("obs_date"))


def calendar_gap(checklists: DataFrame, start: str, end: str, as_of: str | None = None,
                 lag_days: int = P.LAG_DAYS) -> DataFrame:
    """Settled dates of a range on which nothing is stored."""
    spine = calendar(checklists.sparkSession, start, end, as_of, lag_days)
    return spine.join(checklists.select("obs_date").distinct(), "obs_date", "left_anti")


def backfill_plan(gap: DataFrame, max_days: int | None = None, chunk: int = P.CHUNK_DAYS,
                  calls_per_day: int = P.CALLS_PER_DAY) -> DataFrame:
    """Chunks of missing days with the weeks they reach and a call estimate.

    The window has no partition key: a calendar has a few thousand days.
    """
    ranked = gap.withColumn("rn", F.row_number().over(Window.orderBy("obs_date")))
    if max_days is not None:
        ranked = ranked.where(F.col("rn") <= max_days)
    return (ranked.withColumn("chunk", F.expr(f"cast((rn - 1) div {chunk} as int) + 1"))
            .groupBy("chunk")
            .agg(F.min("obs_date").alias("from_date"), F.max("obs_date").alias("to_date"),
                 F.count(F.lit(1)).alias("n_days"),
                 F.sort_array(F.collect_set(week_of(F.col("obs_date")))).alias("weeks"),
                 (F.count(F.lit(1)) * F.lit(calls_per_day + 1)).alias("n_calls")))


def settled_window(checklists: DataFrame, as_of: str, lag_days: int = P.LAG_DAYS,
                   window_days: int = P.WINDOW_DAYS) -> DataFrame:
    """Outings of the last settled days: late filings get ``lag_days`` to arrive."""
    end = F.date_sub(F.lit(as_of).cast("date"), lag_days)
    return checklists.where(F.col("obs_date").between(F.date_sub(end, window_days - 1), end))


def settled_days(spark, as_of: str, lag_days: int = P.LAG_DAYS,
                 window_days: int = P.WINDOW_DAYS) -> DataFrame:
    """The day list of that window."""
    end = F.date_sub(F.lit(as_of).cast("date"), lag_days)
    return spark.range(1).select(
        F.explode(F.sequence(F.date_sub(end, window_days - 1), end)).alias("date")).select(
        "date", F.lit("daily").alias("kind"), F.lit(0.0).alias("wind_max"))


def extreme_days(daily: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """One day per year and month: the windiest of odd months, the calmest of
    even ones.

    ``daily`` has date, wind_max, precip and temp_mean. Days without wind are
    left out; the earlier day wins a tie. ``first`` and ``last`` bound the dates.
    """
    if first:
        daily = daily.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        daily = daily.where(F.col("date") <= F.lit(last).cast("date"))
    month = F.month("date")
    odd = month % 2 == 1
    signed = F.when(odd, F.col("wind_max")).otherwise(-F.col("wind_max"))
    ranked = F.struct(signed.alias("w"), (-F.unix_date("date")).alias("d"))
    return (daily.where(F.col("wind_max").isNotNull())
            .groupBy(F.year("date").alias("year"), month.alias("month"))
            .agg(F.max(F.struct(ranked.alias("r"), F.col("date"), F.col("wind_max"),
                                F.col("precip"), F.col("temp_mean"))).alias("b"))
            .select("year", "month", "b.date", "b.wind_max", "b.precip", "b.temp_mean",
                    F.when(F.col("month") % 2 == 1, "windy").otherwise("calm").alias("kind")))
