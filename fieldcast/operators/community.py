"""Users' own logs and the effort-adjusted leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import clock_hour, sigmoid
from fieldcast.operators.coefficients import modelled_sites
from fieldcast.operators.dedup import salted_join, top_by
from fieldcast.operators.ranks import running_totals
from fieldcast.operators.scoring import (effort_logit, reason, site_effects, weather_logit,
                                         with_terms)


def user_lists(checklists: DataFrame, observations: DataFrame) -> DataFrame:
    """Each user's lists with their species count, numbered newest first.

    The number is a running count with one bucket per day, so the lists of a
    very busy user are sorted day by day and not in one task.
    """
    n = observations.groupBy("sub_id").agg(F.countDistinct("species_code").alias("n_species"))
    newest = F.struct((-F.unix_date("obs_date")).alias("day"),
                      F.coalesce(-clock_hour(F.col("obs_time")), F.lit(1.0)).alias("time"),
                      F.col("sub_id").alias("id"))
    rows = (checklists.select("observer", "sub_id", "loc_id", "obs_date", "obs_time", "duration_hrs")
            .withColumn("newest", newest).withColumn("one", F.lit(1)))
    numbered = running_totals(rows, ["observer"], "newest", F.col("newest.day"), {"one": "position"})
    return (numbered.drop("newest", "one", "position_all").join(n, "sub_id", "left")
            .withColumn("n_species", F.coalesce("n_species", F.lit(0))))


def user_summary(checklists: DataFrame, observations: DataFrame) -> DataFrame:
    """Lists, hours and distinct species per user.

    Species are reduced to distinct (user, species) before counting, so a user
    with very many lists is combined on the map side.
    """
    base = checklists.groupBy("observer").agg(
        F.count(F.lit(1)).alias("n_lists"), F.sum("duration_hrs").alias("hours"))
    species = (observations.select("sub_id", "species_code")
               .join(checklists.select("sub_id", "observer"), "sub_id", "inner")
               .select("observer", "species_code").distinct()
               .groupBy("observer").agg(F.count(F.lit(1)).alias("n_species")))
    return (base.join(species, "observer", "left")
            .withColumn("n_species", F.coalesce("n_species", F.lit(0))))


def expected_species(table: DataFrame, coefs: DataFrame, min_support: float = P.MIN_PER_HOUR,
                     salts: int | None = None) -> DataFrame:
    """One row per outing and species: seen (``y``) and expected (``p``) at its own effort.

    ``p`` is null where the model gives a reason instead of a number, and
    ``first`` marks one row of each outing. The effects of a site with its own
    are packed into one array and joined by site; all other outings take the
    pooled array, which the species list bounds. The join salts the
    pooled site, which holds about half of all outings. The outings x species rows come
    from an explode afterwards and meet only lookups bounded by the species
    list; callers sum them before anything moves.
    """
    pair = F.sort_array(F.collect_list(F.struct("species_code", "site_effect")))
    one = F.lit(P.POOLED_SITE).alias("loc_id")
    pooled = site_effects(coefs, coefs.sparkSession.range(1).select(one)).select(pair).scalar()
    packed = (site_effects(coefs, modelled_sites(coefs))
              .groupBy(F.col("loc_id").alias("site")).agg(pair.alias("own")))
    keep = ["sub_id", "observer", "obs_date", "duration_hrs", "distance_km", "n_observers",
            "traveling", "hr", "week", "site", "seen", "wind_max", "temp_mean", "precip_sum",
            "cloud_mean"]
    wide = salted_join(table.select(*keep), packed, ["site"], "left", F.col("sub_id"),
                       F.col("site") == P.POOLED_SITE, salts)
    long = wide.select(*[c for c in keep if c != "site"],
                       F.posexplode(F.coalesce("own", pooled)).alias("at", "e"))
    long = long.select("*", "e.species_code", "e.site_effect").drop("e")
    cells = with_terms(long.withColumnRenamed("hr", "hour"), coefs, "left")
    total = (F.col("b_intercept") + F.coalesce("hour_term", F.lit(0.0)) + F.col("week_term")
             + F.col("site_effect")
             + effort_logit(F.col("duration_hrs"), F.coalesce("distance_km", F.lit(0.0)),
                            F.col("n_observers").cast("double"), F.col("traveling").cast("double"))
             + weather_logit())
    return cells.select(
        "observer", "sub_id", "obs_date", "duration_hrs", (F.col("at") == 0).alias("first"),
        F.when(reason(min_support).isNull(), sigmoid(total)).alias("p"),
        F.array_contains("seen", F.col("species_code")).cast("int").alias("y"))


def leaderboard(table: DataFrame, coefs: DataFrame, min_support: float = P.MIN_PER_HOUR
                ) -> DataFrame:
    """Users per month by species found over species expected for their effort.

    One pass over the outings: sums per user and month, hours counted once per
    outing. A month without a scored outing has no row.
    """
    live = F.col("p").isNotNull()
    return (expected_species(table, coefs, min_support)
            .groupBy("observer", F.date_format("obs_date", "yyyy-MM").alias("month"))
            .agg(F.sum(F.when(live, F.col("y"))).alias("found"), F.sum("p").alias("expected"),
                 F.sum(F.when(F.col("first"), F.col("duration_hrs"))).alias("hours"),
                 F.count_if("first").alias("n_lists"))
            .where(F.col("expected").isNotNull())
            .withColumn("efficiency", F.try_divide(F.col("found").cast("double"),
                                                   F.col("expected"))))


def top_of_leaderboard(board: DataFrame, k: int) -> DataFrame:
    """The first ``k`` users of each month."""
    return top_by(board, ["month"], [F.round("efficiency", 9).desc_nulls_last(),
                                     F.col("observer")], k, "rank")
