"""Best hours and best sites straight from the terms, without the grid.

Within one species and area a logit is a part per slot plus an effect per site.
The best slot of a site and the best sites of a slot therefore follow from the
parts and the effects alone: nothing of the size species x sites x slots is
built. ``scoring`` has the same rankings over a stored grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import sigmoid
from fieldcast.operators.dedup import top_by
from fieldcast.operators.scoring import (Outing, WEATHER, area_slots, by_probability, intensity,
                                         site_effects, site_free_sums, spread)
from fieldcast.session import stored


def best_window(coefs: DataFrame, spans: DataFrame, sites: DataFrame, area: Sequence[str],
                outing: Outing = Outing(), min_support: float = P.MIN_PER_HOUR,
                carry: Sequence[str] = ()) -> DataFrame:
    """Best (day, hour) per species and site; the earlier cell wins a tie.

    Each site meets its area's array of slots and keeps one of them in-row.
    ``carry`` may name ``site_effect`` and weather columns.
    """
    slots = stored(area_slots(coefs, spans, area, outing, min_support).withColumn(
        "slots", F.filter("slots", lambda s: s["part"].isNotNull())), "slots")
    pairs = spread(site_effects(coefs, sites.select("loc_id", *area)), ["species_code", "loc_id"]).join(
        slots, ["species_code", *area], "inner")

    def order(s: Column) -> Column:
        p = sigmoid(s["part"] + F.col("site_effect"))
        return F.struct(F.round(p, 9).alias("order"), (-F.unix_date(s["day"])).alias("d"),
                        (-s["hour"]).alias("h"), p.alias("probability"), s["day"].alias("day"),
                        s["hour"].alias("hour"), *[s[c].alias(c) for c in WEATHER])

    best = pairs.withColumn("b", F.array_max(F.transform("slots", order))).where(
        F.col("b").isNotNull())
    carried = [F.col("site_effect") if c == "site_effect" else F.col(f"b.{c}") for c in carry]
    return best.select("species_code", "loc_id", "b.day", "b.hour",
                       (F.col("b.hour") + 1).alias("until_hour"), "b.probability", *carried)


def best_probability(coefs: DataFrame, spans: DataFrame, sites: DataFrame, area: Sequence[str],
                     outing: Outing = Outing(), min_support: float = P.MIN_PER_HOUR) -> DataFrame:
    """(species_code, loc_id, best_probability, has_site_effect), null where no slot is live."""
    top = (site_free_sums(coefs, spans, outing, min_support)
           .groupBy("species_code", *area).agg(F.max("part").alias("part")))
    pairs = site_effects(coefs, sites.select("loc_id", *area))
    return pairs.join(top, ["species_code", *area], "left").select(
        "species_code", "loc_id",
        sigmoid(F.col("part") + F.col("site_effect")).alias("best_probability"), "has_site_effect")


def best_hotspots(coefs: DataFrame, spans: DataFrame, sites: DataFrame, area: Sequence[str],
                  outing: Outing = Outing(), k: int = 12, min_support: float = P.MIN_PER_HOUR
                  ) -> DataFrame:
    """Top sites per species, day and hour, with the slice's range and intensity.

    In an area the same sites lead in every slot, those of the highest effects,
    so ``k`` sites per (species, area) stand for all of them. Equal effects go
    by loc_id, and so do probabilities equal at nine digits among these.
    """
    area, keys = list(area), ["species_code", "day", "hour"]
    effects = site_effects(coefs, sites.select("loc_id", *area))
    leaders = top_by(effects, ["species_code", *area],
                     [F.col("site_effect").desc(), F.col("loc_id")], k)
    ends = effects.groupBy("species_code", *area).agg(
        F.min("site_effect").alias("lo"), F.max("site_effect").alias("hi"),
        F.count(F.lit(1)).alias("n"))
    live = (site_free_sums(coefs, spans, outing, min_support)
            .where(F.col("part").isNotNull()).select(*keys, *area, "part"))
    p = sigmoid(F.col("part") + F.col("site_effect"))
    shown = live.join(leaders, ["species_code", *area], "inner").withColumn("probability", p)
    best = top_by(shown, keys, [by_probability().desc(), F.col("loc_id")], k, "rank")
    at = lambda c: sigmoid(F.col("part") + F.col(c))
    slice_range = live.join(ends, ["species_code", *area], "inner").groupBy(*keys).agg(
        F.min(at("lo")).alias("lo"), F.max(at("hi")).alias("hi"), F.sum("n").alias("n_scored"))
    return (best.join(slice_range, keys, "inner")
            .withColumn("t", intensity(F.col("probability"), F.col("lo"), F.col("hi"))))
