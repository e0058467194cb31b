"""Forecasts on request: only the rows asked for are scored.

A request names a species, a place, and what is planned. Its terms, its site's
effect and its area's week of weather join at the size of the requests; the
slots are an in-row array and the grid is the last in-stage explode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import sigmoid, week_of
from fieldcast.operators.coefficients import heads, term_block
from fieldcast.operators.scoring import (Outing, WEATHER, best_window, closest_weeks, drivers,
                                         modelled_weeks, outside_area, reason, site_free_logit,
                                         spans_by_length, terms_at, weather_known)
from fieldcast.operators.spatial import nearest_sites

PLANNED = ("duration_hrs", "distance_km", "n_observers", "traveling")


def _outing() -> Outing:
    return Outing(*[F.col(c) for c in PLANNED])


def _plannable() -> Column:
    whole = (F.col("duration_hrs") > 0) & (F.col("duration_hrs") <= 24)
    for c in ("distance_km", "n_observers"):
        whole = whole & (F.col(c) >= 0)
    return F.coalesce(whole & F.col("traveling").isNotNull(), F.lit(False))


def placed_requests(requests: DataFrame, hotspots: DataFrame,
                    radius_km: float = P.SITE_SNAP_KM) -> DataFrame:
    """Requests with ``loc_id`` (the site named, else the nearest one within reach)
    and the reason to refuse: ``area`` outside the box, ``outing`` for a plan
    that has a missing or impossible value."""
    asked = outside_area(requests).drop("in_coverage").withColumn(
        "reason", F.when(F.col("lat").isNull() | F.col("lon").isNull(), "area")
        .otherwise(F.coalesce("reason", F.when(~_plannable(), "outing"))))
    lost = asked.where(F.col("loc_id").isNull() & F.col("reason").isNull()).select(
        F.col("request_id").alias("point_id"), "lat", "lon")
    near = nearest_sites(lost, hotspots, 1, radius_km).select(
        F.col("point_id").alias("request_id"), F.col("loc_id").alias("_near"))
    return (asked.join(near, "request_id", "left")
            .withColumn("loc_id", F.coalesce("loc_id", "_near")).drop("_near"))


def forecast_requests(requests: DataFrame, coefs: DataFrame, forecast: DataFrame,
                      hotspots: DataFrame, area: Sequence[str],
                      min_support: float = P.MIN_PER_HOUR) -> DataFrame:
    """Probability or reason per request, day and hour of its coming week.

    ``requests`` has a unique request_id, species_code, lat, lon, loc_id (may be
    null), the ``area`` columns, duration_hrs, distance_km, n_observers and
    traveling. ``forecast`` is hourly weather per area; ``hotspots`` has loc_id,
    latitude, longitude. A request that cannot be scored at all keeps one row
    without day and hour: reason ``area``, ``outing``, ``species`` (no model) or
    ``forecast`` (no weather for the area).
    """
    area = list(area)
    placed = placed_requests(requests, hotspots).withColumn(
        "n_span", F.when(F.col("reason").isNull(), F.ceil("duration_hrs").cast("int")))
    own = term_block(coefs, "site", "loc_id", "own_effect").where(F.col("loc_id") != P.POOLED_SITE)
    pooled = (term_block(coefs, "site", "loc_id", "pooled").where(F.col("loc_id") == P.POOLED_SITE)
              .select("species_code", "pooled"))
    known = (placed.join(own, ["species_code", "loc_id"], "left")
             .join(pooled, "species_code", "left")
             .withColumn("has_site_effect", F.col("own_effect").isNotNull())
             .withColumn("site_effect", F.coalesce("own_effect", "pooled", F.lit(0.0)))
             .drop("own_effect", "pooled")
             .join(heads(coefs), "species_code", "left")
             .withColumn("reason", F.coalesce("reason", F.when(
                 F.col("b_intercept").isNull(), "species"))))
    lengths = placed.where(F.col("n_span").isNotNull()).select(*area, "n_span").distinct()
    slot = F.struct("day", "hour", "n_hours", *WEATHER)
    # a week's slots: 105 of each area and length
    packed = (spans_by_length(forecast, lengths, area).groupBy(*area, "n_span")
              .agg(F.collect_list(slot).alias("slots")))
    cells = known.join(packed, [*area, "n_span"], "left").withColumn(
        "slots", F.when(F.col("reason").isNull(), F.col("slots")))
    cells = cells.withColumnRenamed("reason", "refused").select("*", F.inline_outer("slots"))
    cells = terms_at(cells.drop("slots").withColumn("week", week_of(F.col("day"))))
    cells = cells.withColumn("reason", F.coalesce(
        "refused", F.when(F.col("day").isNull(), "forecast"), reason(min_support, weather_known())))
    p = sigmoid(site_free_logit(_outing()) + F.col("site_effect"))
    return cells.select(
        "request_id", "species_code", "loc_id", "has_site_effect", "site_effect", *PLANNED,
        "day", "hour", "week", *WEATHER, "reason",
        F.when(F.col("reason").isNull(), p).alias("probability"))


def request_summary(grid: DataFrame, coefs: DataFrame, k: int = 3) -> DataFrame:
    """One row per request: best window, slots scored, and which weeks the model covers.

    ``nearest_weeks`` is given where no slot is scored and some fail for their
    week: the ``k`` modelled weeks closest to the first day's.
    """
    keys = ["request_id", "species_code"]
    best = best_window(grid, keys)
    tally = grid.groupBy(*keys).agg(
        F.count("day").alias("n_slots"), F.count("probability").alias("n_scored"),
        F.count_if(F.col("reason") == "week").alias("n_week"), F.min_by("week", "day").alias("week"))
    unmodelled = (F.col("n_week") > 0) & (F.col("n_scored") == 0)
    near = F.transform(closest_weeks(F.col("weeks"), F.col("week"), k), lambda x: x["nearest"])
    return (tally.join(best, keys, "left").join(modelled_weeks(coefs), "species_code", "left")
            .select(*keys, "day", "hour", "until_hour", "probability", "n_slots", "n_scored",
                    F.col("weeks").alias("modelled_weeks"),
                    F.when(unmodelled, near).alias("nearest_weeks")))


def request_drivers(grid: DataFrame, coefs: DataFrame) -> DataFrame:
    """What time, duration and weather are worth at each request's best window."""
    carry = ["site_effect", *PLANNED, *WEATHER]
    best = best_window(grid, ["request_id", "species_code"], carry=carry)
    return drivers(coefs, best, _outing(), keys=["request_id", "species_code", "day", "hour"])
