"""Forecast scoring: a sum of looked-up terms and a sigmoid, or a reason.

Order of work for a full grid of species, sites and hours: everything that
does not depend on the site is summed once per (species, area, day, hour) and
packed into one array per (species, area), 105 slots for a week. Site effects
are joined at the size of species x sites. The grid itself is only the final
in-stage explode, so its rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import round_half_up_int, sigmoid, week_of
from fieldcast.operators.coefficients import heads, term_block
from fieldcast.operators.dedup import top_by
from fieldcast.operators.labels import species_array
from fieldcast.session import stored

WEATHER = ("wind_max", "temp_mean", "precip_sum", "cloud_mean")


def by_probability(column: str = "probability") -> Column:
    """Ranking value: nine digits, so ranks do not hang on summation order."""
    return F.round(column, 9)


@dataclass(frozen=True)
class Outing:
    """What the user plans: hours, kilometres, people, and whether on the move.

    Each is one value for all rows, or a column of the rows scored.
    """

    duration_hrs: float | Column = 1.0
    distance_km: float | Column = 1.0
    observers: int | Column = 1
    traveling: bool | Column = True


def first_days(forecast: DataFrame, area: Sequence[str], days: int) -> DataFrame:
    """The first ``days`` distinct dates per area."""
    dates = forecast.select(*area, F.col("ts").cast("date").alias("day")).distinct()
    return top_by(dates, area, [F.col("day")], days)


def forecast_span(forecast: DataFrame, area: Sequence[str], duration_hrs: float,
                  hours: Sequence[int] = P.FORECAST_HOURS, days: int = P.FORECAST_DAYS
                  ) -> DataFrame:
    """Weather over the hours an outing would span, per area, day and start hour.

    Serving spans differ from training spans on purpose: they run from the
    start hour for ``ceil(duration)`` hours, end with the day, and skip hours
    the forecast lacks. A start hour without any forecast hour keeps its row
    with null weather and ``n_hours`` 0.
    """
    length = F.lit(max(1, math.ceil(duration_hrs)))
    return _spans(forecast, first_days(forecast, area, days), list(area), length, hours)


def spans_by_length(forecast: DataFrame, lengths: DataFrame, area: Sequence[str],
                    hours: Sequence[int] = P.FORECAST_HOURS, days: int = P.FORECAST_DAYS
                    ) -> DataFrame:
    """:func:`forecast_span` for each (area, ``n_span``) of ``lengths``, in whole hours.

    ``lengths`` holds distinct rows; an area's hours meet each of its lengths once.
    """
    area = list(area)
    wanted = first_days(forecast, area, days).join(lengths, area, "inner")
    return _spans(forecast.join(lengths, area, "inner"), wanted, [*area, "n_span"],
                  F.col("n_span"), hours)


def _spans(forecast: DataFrame, wanted: DataFrame, keys: Sequence[str], length: Column,
           hours: Sequence[int]) -> DataFrame:
    hour = F.hour("ts").cast("int")
    day_hours = F.array(*[F.lit(h) for h in hours])
    starts = F.filter(F.sequence(hour - (length - 1), hour),
                      lambda h: F.array_contains(day_hours, h))
    agg = (forecast.withColumn("day", F.col("ts").cast("date"))
           .select(*keys, "day", "wind", "temp", "precip", "cloud", F.explode(starts).alias("hour"))
           .groupBy(*keys, "day", "hour")
           .agg(F.max("wind").alias("wind_max"), F.avg("temp").alias("temp_mean"),
                F.sum("precip").alias("precip_sum"), F.avg("cloud").alias("cloud_mean"),
                F.count(F.lit(1)).alias("n_hours")))
    return (wanted.withColumn("hour", F.explode(day_hours))
            .join(agg, [*keys, "day", "hour"], "left")
            .withColumn("n_hours", F.coalesce("n_hours", F.lit(0)).cast("long")))


def reason(min_support: float, has_weather: Column | None = None) -> Column:
    """Why a cell has no number: forecast, then hour, then week; null when it has."""
    no_hour = F.coalesce("support", F.lit(0.0)) < F.lit(float(min_support))
    r = F.when(no_hour, "hour").when(F.col("week_term").isNull(), "week")
    return r if has_weather is None else F.when(~has_weather, "forecast").otherwise(r)


def with_terms(cells: DataFrame, coefs: DataFrame, how: str = "left",
               extra: Sequence[str] = ()) -> DataFrame:
    """Attach a species' terms to cells that have species_code, hour and week."""
    return terms_at(cells.join(heads(coefs, extra), "species_code", how))


def terms_at(cells: DataFrame) -> DataFrame:
    """The terms of a cell's hour and week, out of its species' arrays."""
    return (cells.withColumn("hour_term", F.get("hour_terms", F.col("hour")))
            .withColumn("support", F.get("support_terms", F.col("hour")))
            .withColumn("week_term", F.get("week_terms", F.col("week"))))


def unavailable(cells: DataFrame, coefs: DataFrame, min_support: float = P.MIN_PER_HOUR
                ) -> DataFrame:
    """Reason per (species, day, hour) cell; the hour is checked before the week."""
    return (with_terms(cells, coefs).withColumn("reason", reason(min_support))
            .select(*cells.columns, "reason"))


def effort_logit(duration: Column, distance: Column, observers: Column, traveling: Column) -> Column:
    return (F.col("b_log_dur") * F.ln(duration) + F.col("b_log_dist") * F.log1p(distance)
            + F.col("b_n_observers") * observers + F.col("b_traveling") * traveling)


def weather_logit(values: dict[str, Column] | None = None) -> Column:
    v = {c: F.col(c) for c in WEATHER} | (values or {})
    total = F.lit(0.0)
    for c in WEATHER:
        total = total + F.col(f"b_{c}") * v[c]
    return total


def outing_logit(o: Outing, duration: float | None = None) -> Column:
    d = o.duration_hrs if duration is None else duration
    return effort_logit(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x))
                          for x in (d, o.distance_km, o.observers, o.traveling)])


def weather_known() -> Column:
    """Whether a span has any forecast hour and no weather is missing."""
    known = F.col("n_hours") > 0
    for c in WEATHER:
        known = known & F.col(c).isNotNull()
    return known


def site_free_logit(outing: Outing) -> Column:
    """All parts of the sum but the site's, of a row with its terms and weather."""
    zero = F.lit(0.0)
    return (F.coalesce("b_intercept", zero) + F.coalesce("hour_term", zero)
            + F.coalesce("week_term", zero) + outing_logit(outing) + weather_logit())


def site_effects(coefs: DataFrame, sites: DataFrame) -> DataFrame:
    """Every site with every species: own effect, else the pooled one, else 0.

    ``sites`` needs loc_id and may carry more columns. The species list is a
    constant array, so the pairs come from an explode, and one join at
    species x sites brings the effects.
    """
    own = term_block(coefs, "site", "loc_id", "own_effect").where(F.col("loc_id") != P.POOLED_SITE)
    pooled = (term_block(coefs, "site", "loc_id", "pooled").where(F.col("loc_id") == P.POOLED_SITE)
              .select("species_code", "pooled"))
    pairs = sites.withColumn("species_code", F.explode(species_array(coefs)))
    return (pairs.join(own, ["species_code", "loc_id"], "left")
            .join(pooled, "species_code", "left")
            .withColumn("has_site_effect", F.col("own_effect").isNotNull())
            .withColumn("site_effect", F.coalesce("own_effect", "pooled", F.lit(0.0)))
            .drop("own_effect", "pooled"))


def site_free_sums(coefs: DataFrame, spans: DataFrame, outing: Outing,
                   min_support: float = P.MIN_PER_HOUR) -> DataFrame:
    """The reason, or all parts of the sum but the site's, per species and span."""
    cells = (spans.withColumn("week", week_of(F.col("day")))
             .withColumn("species_code", F.explode(species_array(coefs))))
    scored = with_terms(cells, coefs).withColumn("reason", reason(min_support, weather_known()))
    return scored.withColumn("part", F.when(F.col("reason").isNull(), site_free_logit(outing)))


def area_slots(coefs: DataFrame, spans: DataFrame, area: Sequence[str], outing: Outing,
               min_support: float = P.MIN_PER_HOUR) -> DataFrame:
    """Site-free sums per (species, area), packed in one array of a week's slots."""
    slot = F.struct("day", "hour", "reason", "part", *WEATHER)
    return (site_free_sums(coefs, spans, outing, min_support)
            .groupBy("species_code", *area).agg(F.collect_list(slot).alias("slots")))


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` dealt over the cores by ``keys``, for a stage that makes many rows of each.

    Adaptive execution sizes tasks by the bytes they read, and an area's slots or a
    species' sites share one key: either leaves a week's slots of all sites to a few
    tasks. The number is given, so it is not coalesced.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def score_grid(coefs: DataFrame, spans: DataFrame, sites: DataFrame, area: Sequence[str],
               outing: Outing = Outing(), min_support: float = P.MIN_PER_HOUR,
               keep: Sequence[str] = ()) -> DataFrame:
    """Probability or reason for every species, site, day and hour.

    ``spans`` is the output of :func:`forecast_span`; ``sites`` has loc_id and
    the area columns, of which ``keep`` are carried along. A site in an area without
    any forecast has one row per species, with the reason and no day or hour. The
    slots are stored, so that they go to the sites and not the sites to them.
    """
    slots = stored(area_slots(coefs, spans, area, outing, min_support), "slots")
    pairs = spread(site_effects(coefs, sites.select("loc_id", *area)), ["species_code", "loc_id"])
    grid = pairs.join(slots, ["species_code", *area], "left").select(
        "species_code", "loc_id", *keep, "has_site_effect", "site_effect", F.inline_outer("slots"))
    return (grid.withColumn("reason", F.when(F.col("day").isNull(), "forecast")
                            .otherwise(F.col("reason")))
            .withColumn("probability", sigmoid(F.col("part") + F.col("site_effect")))
            .drop("part"))


def drivers(coefs: DataFrame, cells: DataFrame, outing: Outing = Outing(),
            keys: Sequence[str] = ("species_code", "loc_id", "day", "hour")) -> DataFrame:
    """What time, duration and weather are worth, in points, per given cell.

    ``cells`` has species_code, loc_id, day, hour, site_effect and weather. Each
    is re-scored with one choice restored on top of a reference outing; the
    support floor does not apply. Points need not add up to the total, and a
    week without a term gives null throughout. ``keys`` are carried along.
    """
    df = with_terms(cells.withColumn("week", week_of(F.col("day"))), coefs)
    zero = F.lit(0.0)
    hour_now = F.coalesce("hour_term", zero)
    hour_ref = F.coalesce(F.get("hour_terms", F.lit(P.REFERENCE_HOUR)), zero)
    now, brief = outing_logit(outing), outing_logit(outing, P.REFERENCE_DURATION_HRS)
    wx_now, wx_ref = weather_logit(), weather_logit({"wind_max": F.lit(P.REFERENCE_WIND)})
    fixed = F.coalesce("b_intercept", zero) + F.col("week_term") + F.col("site_effect")

    def at(hour_part: Column, effort: Column, wx: Column) -> Column:
        return sigmoid(fixed + hour_part + effort + wx)

    base = at(hour_ref, brief, wx_ref)
    rows = [("time of day", at(hour_now, brief, wx_ref) - base),
            ("how long", at(hour_ref, now, wx_ref) - base),
            ("weather", at(hour_ref, brief, wx_now) - base),
            ("total", at(hour_now, now, wx_now))]
    made = F.array(*[F.struct(F.lit(k).alias("label"),
                              round_half_up_int(v * F.lit(100.0)).alias("points"))
                     for k, v in rows])
    return df.select(*keys, F.inline(made))


def slice_range(grid: DataFrame, slice_by: Sequence[str]) -> DataFrame:
    """Lowest and highest probability and number of scored sites per slice."""
    return (grid.where(F.col("probability").isNotNull()).groupBy(*slice_by)
            .agg(F.min("probability").alias("lo"), F.max("probability").alias("hi"),
                 F.count(F.lit(1)).alias("n_scored")))


def intensity(p: Column, lo: Column, hi: Column) -> Column:
    """Position between lo and hi; one half when they are equal."""
    return F.when(hi == lo, F.lit(0.5)).otherwise((p - lo) / F.nullif(hi - lo, F.lit(0.0)))


def best_hotspots(grid: DataFrame, slice_by: Sequence[str] = ("species_code", "day", "hour"),
                  k: int = 12) -> DataFrame:
    """Top sites per slice with the slice's range and a 0-1 intensity."""
    live = grid.where(F.col("probability").isNotNull())
    best = top_by(live, slice_by, [by_probability().desc(), F.col("loc_id")], k, "rank")
    return (best.join(slice_range(grid, slice_by), list(slice_by), "inner")
            .withColumn("t", intensity(F.col("probability"), F.col("lo"), F.col("hi"))))


def with_intensity(grid: DataFrame, slice_by: Sequence[str] = ("species_code", "day", "hour")
                   ) -> DataFrame:
    """Every scored site with its 0-1 intensity within the slice."""
    return (grid.where(F.col("probability").isNotNull())
            .join(slice_range(grid, slice_by), list(slice_by), "inner")
            .withColumn("t", intensity(F.col("probability"), F.col("lo"), F.col("hi"))))


def best_window(grid: DataFrame, keys: Sequence[str] = ("species_code", "loc_id"),
                carry: Sequence[str] = ()) -> DataFrame:
    """Best (day, hour) per key; the earlier cell wins a tie.

    A plain max over a struct, so it combines map-side at any group size.
    """
    order = F.struct(by_probability().alias("p"), (-F.unix_date("day")).alias("d"),
                     (-F.col("hour")).alias("h"))
    return (grid.where(F.col("probability").isNotNull()).groupBy(*keys)
            .agg(F.max(F.struct(order.alias("o"), "day", "hour", "probability", *carry)).alias("b"))
            .select(*keys, "b.day", "b.hour", (F.col("b.hour") + 1).alias("until_hour"),
                    "b.probability", *[f"b.{c}" for c in carry]))


def shortlist_of_grid(grid: DataFrame, k: int = 24,
                      keys: Sequence[str] = ("loc_id", "day", "hour")) -> DataFrame:
    """Likeliest species at a site, day and hour, from a stored grid."""
    return top_by(grid.where(F.col("probability").isNotNull()), keys,
                  [by_probability().desc(), F.col("species_code")], k, "rank")


def species_shortlist(coefs: DataFrame, spans: DataFrame, sites: DataFrame, area: Sequence[str],
                      outing: Outing = Outing(), k: int = 24,
                      min_support: float = P.MIN_PER_HOUR) -> DataFrame:
    """Likeliest species at every site, day and hour, straight from the terms.

    All species of a slot sit in one array, as do all effects of a site, both
    bounded by the species list and in its order. They meet by area, one row per
    site and slot, and each row sorts its own short array: the grid of species x
    sites x slots is never shuffled.
    """
    area = list(area)
    parts = stored(site_free_sums(coefs, spans, outing, min_support)
                   .groupBy(*area, "day", "hour")
                   .agg(F.sort_array(F.collect_list(F.struct("species_code", "part"))).alias("parts")),
                   "parts")
    effects = (site_effects(coefs, sites.select("loc_id", *area)).groupBy("loc_id", *area)
               .agg(F.sort_array(F.collect_list(F.struct("species_code", "site_effect")))
                    .alias("effects")))
    rows = spread(effects, ["loc_id"]).join(parts, area, "inner")

    def scored(x: Column, e: Column) -> Column:
        p = sigmoid(x["part"] + e["site_effect"])
        return F.struct((-F.round(p, 9)).alias("order"), x["species_code"].alias("species_code"),
                        p.alias("probability"))

    live = F.filter(F.zip_with("parts", "effects", scored), lambda x: x["order"].isNotNull())
    best = F.slice(F.sort_array(live), 1, k)
    return (rows.select("loc_id", "day", "hour", F.posexplode(best))
            .select("loc_id", "day", "hour", (F.col("pos") + 1).alias("rank"),
                    "col.species_code", "col.probability"))


def weather_effect(coefs: DataFrame, best: DataFrame, outing: Outing = Outing()) -> DataFrame:
    """Points that the forecast adds at the best site against median weather.

    ``best`` is the first site per slice with site_effect and probability.
    """
    median = {k: F.lit(v) for k, v in P.MEDIAN_WEATHER.items()}
    df = with_terms(best.withColumn("week", week_of(F.col("day"))), coefs)
    at_median = sigmoid(F.coalesce("b_intercept", F.lit(0.0)) + F.coalesce("hour_term", F.lit(0.0))
                        + F.col("week_term") + F.col("site_effect") + outing_logit(outing)
                        + weather_logit(median))
    return (df.withColumn("at_median", at_median)
            .withColumn("points", (F.col("probability") - F.col("at_median")) * F.lit(100.0))
            .select("species_code", "day", "hour", "loc_id", "probability", "at_median", "points"))


def modelled_weeks(coefs: DataFrame) -> DataFrame:
    """Sorted array of modelled weeks per species (empty when none)."""
    week = F.when(F.col("term").startswith("week_"), F.substring("term", 6, 2).try_cast("int"))
    return coefs.groupBy("species_code").agg(F.sort_array(F.collect_set(week)).alias("weeks"))


def week_coverage(coefs: DataFrame, as_of: str) -> DataFrame:
    """53 cells per species: fitted or not, and which holds the given date."""
    now = week_of(F.lit(as_of).cast("date"))
    return (modelled_weeks(coefs)
            .withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(P.WEEKS_IN_YEAR - 1))))
            .withColumn("fitted", F.array_contains("weeks", F.col("week")))
            .withColumn("is_current", F.col("week") == now).drop("weeks"))


def nearest_weeks(coefs: DataFrame, k: int = 3) -> DataFrame:
    """For each week without a term, the ``k`` closest weeks that have one.

    Distance wraps around the year; the lower week wins a tie. All in-row: the
    candidates are an array of at most 53.
    """
    df = (modelled_weeks(coefs)
          .withColumn("week", F.explode(F.array_except(
              F.sequence(F.lit(0), F.lit(P.WEEKS_IN_YEAR - 1)), F.col("weeks")))))
    ranked = closest_weeks(F.col("weeks"), F.col("week"), k)
    return df.select("species_code", "week", F.posexplode(ranked)).select(
        "species_code", "week", (F.col("pos") + 1).alias("rank"), "col.nearest", "col.distance")


def closest_weeks(weeks: Column, week: Column, k: int) -> Column:
    """The ``k`` of ``weeks`` nearest to ``week`` around the year, as (distance, nearest)."""
    d = lambda w: F.abs(w - week)
    return F.slice(F.sort_array(F.transform(weeks, lambda w: F.struct(
        F.least(d(w), F.lit(P.WEEKS_IN_YEAR) - d(w)).alias("distance"), w.alias("nearest")))), 1, k)


def outside_area(points: DataFrame, lat: str = "lat", lon: str = "lon",
                 extent: dict[str, float] = P.EXTENT) -> DataFrame:
    """Refuse points outside the box before anything is scored."""
    from fieldcast.functions import in_box

    inside = in_box(F.col(lat), F.col(lon), extent)
    return (points.withColumn("in_coverage", inside)
            .withColumn("reason", F.when(~inside, "area")))
