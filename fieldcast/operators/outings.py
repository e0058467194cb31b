"""Eligible outings, their predictors and their species."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import clock_hour, hour_bucket, snap, span_hours, week_of
from fieldcast.functions.clock import at_hour
from fieldcast.operators.dedup import keep_first


def is_species(code: Column, prefix: str = P.NON_SPECIES_PREFIX) -> Column:
    return ~code.startswith(prefix)


def is_eligible(protocols: Sequence[str] = P.PROTOCOLS,
                min_hrs: float = P.MIN_DURATION_HRS, max_hrs: float = P.MAX_DURATION_HRS,
                max_observers: int = P.MAX_OBSERVERS) -> Column:
    """Complete, timed, standard-protocol outings; unknown party sizes drop out."""
    return (F.col("all_reported")
            & F.col("protocol_id").isin(*protocols)
            & F.col("duration_hrs").between(min_hrs, max_hrs)
            & F.col("obs_time").isNotNull()
            & (F.col("n_observers") <= max_observers))


def unique_locations(locations: DataFrame) -> DataFrame:
    """One row per site. Site tables carry no key constraint, and a repeated
    site would multiply its outings in the join."""
    order = [F.col("is_hotspot").desc_nulls_last(), F.col("lat").asc_nulls_last(),
             F.col("lon").asc_nulls_last()]
    return keep_first(locations, ["loc_id"], order)


def eligible_outings(checklists: DataFrame, locations: DataFrame, carry: Sequence[str] = (),
                     **rules) -> DataFrame:
    """Eligible outings at sites with known coordinates; ``carry`` keeps more columns.

    The rules come before the join and reach the Parquet scan. The join is left
    to the planner: it broadcasts the sites when their measured size allows and
    splits hot sites at run time when not.
    """
    cols = ["sub_id", "loc_id", "obs_date", "obs_time", "duration_hrs", "distance_km",
            "n_observers", "protocol_id", *carry]
    sites = unique_locations(locations.select("loc_id", "lat", "lon", "is_hotspot"))
    return (checklists.where(is_eligible(**rules)).select(*cols)
            .join(sites, "loc_id", "inner"))


def observation_summary(observations: DataFrame) -> DataFrame:
    """Per outing: species-only richness and the set of species seen.

    One shuffle for both. The set is bounded by the species list, and the
    partial aggregate removes repeats before the exchange.
    """
    return (observations.where(is_species(F.col("species_code")))
            .groupBy("sub_id")
            .agg(F.count(F.lit(1)).alias("richness"),
                 F.collect_set("species_code").alias("seen")))


def with_richness(outings: DataFrame, observations: DataFrame) -> DataFrame:
    """Left join with zero for outings that recorded nothing."""
    empty = F.array().cast("array<string>")
    return (outings.join(observation_summary(observations), "sub_id", "left")
            .withColumn("richness", F.coalesce("richness", F.lit(0)).cast("long"))
            .withColumn("seen", F.coalesce("seen", empty)))


def with_cell(df: DataFrame, lat: str = "lat", lon: str = "lon",
              degrees: float = P.CELL_DEGREES) -> DataFrame:
    return (df.withColumn("clat", snap(F.col(lat), degrees))
            .withColumn("clon", snap(F.col(lon), degrees)))


def with_span(outings: DataFrame) -> DataFrame:
    """Fractional start hour, first and last hour index."""
    df = outings.withColumn("hour", clock_hour(F.col("obs_time")))
    lo, hi = span_hours(F.col("obs_date"), F.col("hour"), F.col("duration_hrs"))
    return df.withColumn("h_lo", lo).withColumn("h_hi", hi)


def outing_span(outings: DataFrame) -> DataFrame:
    """Start, end, and both snapped to whole hours, as local timestamps."""
    df = with_span(outings)
    day = F.col("obs_date")
    midnight = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 24
    return (df.withColumn("start_ts", at_hour(day, F.col("hour")))
            .withColumn("end_ts", at_hour(day, F.col("hour") + F.col("duration_hrs")))
            .withColumn("span_from", at_hour(day, (F.col("h_lo") - midnight).cast("double")))
            .withColumn("span_to", at_hour(day, (F.col("h_hi") - midnight).cast("double"))))


def with_predictors(df: DataFrame, traveling: str = P.TRAVELING_PROTOCOL) -> DataFrame:
    return (df.withColumn("doy", F.dayofyear("obs_date"))
            .withColumn("log_dur", F.ln("duration_hrs"))
            .withColumn("log_dist", F.log1p(F.coalesce("distance_km", F.lit(0.0))))
            .withColumn("traveling", (F.col("protocol_id") == traveling).cast("int")))


def with_buckets(df: DataFrame) -> DataFrame:
    return (df.withColumn("hr", hour_bucket(F.col("hour")))
            .withColumn("week", week_of(F.col("obs_date"))))


def with_site(df: DataFrame, pooled: str = P.POOLED_SITE) -> DataFrame:
    """Hotspots keep their own id; personal locations pool into one."""
    return df.withColumn("site", F.when(F.col("is_hotspot"), F.col("loc_id"))
                         .otherwise(F.lit(pooled)))


def validate_outings(logged: DataFrame) -> DataFrame:
    """Split user-logged outings by the form's rules: ``problems`` is empty for
    a valid row. An incomplete list is valid; it is only left out of fits."""
    incidental = F.col("protocol") == "incidental"
    rules = {
        "protocol": F.col("protocol").isin("stationary", "traveling", "incidental"),
        "duration_min": F.when(F.col("duration_min").isNull(), incidental)
        .otherwise(F.col("duration_min").between(1, 720)),
        "distance_km": F.when(F.col("distance_km").isNull(), F.col("protocol") != "traveling")
        .otherwise(F.col("distance_km") >= 0),
        "party_size": F.when(F.col("party_size").isNull(), incidental)
        .otherwise(F.col("party_size").between(1, 50)),
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return (logged.withColumn("problems", F.array_compact(F.array(*broken)))
            .withColumn("valid", F.size("problems") == 0))
