"""The model table: one row per eligible outing with all predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.operators.labels import hour_support, supported_only
from fieldcast.operators.outings import (eligible_outings, with_buckets, with_cell, with_predictors,
                                         with_richness, with_site, with_span)
from fieldcast.operators.weather import lacks_weather, require_weather, with_weather


def outing_features(checklists: DataFrame, locations: DataFrame, **rules) -> DataFrame:
    """Everything that needs neither observations nor weather."""
    placed = with_cell(eligible_outings(checklists, locations, **rules))
    return with_site(with_buckets(with_predictors(with_span(placed))))


def model_table(checklists: DataFrame, locations: DataFrame, observations: DataFrame,
                weather: DataFrame, **rules) -> DataFrame:
    """Eligible outings with weather, predictors, richness and species seen.

    Labels stay as one set per outing; see ``labels.presence_absence`` for the
    long form and ``labels.wide_labels`` for columns.
    """
    return with_richness(with_weather(outing_features(checklists, locations, **rules), weather),
                         observations)


def fit_table(table: DataFrame, min_per_hour: int = P.MIN_PER_HOUR,
              drop_without_weather: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows a fit may use, and the hour counts: full weather, supported hours.

    An outing without weather fails the job unless the caller asks for such
    outings to be dropped; ``weather_gate`` counts them.
    """
    table = table.where(~lacks_weather()) if drop_without_weather else require_weather(table)
    whole = table.where(F.col("hr").isNotNull())
    support = hour_support(whole, min_per_hour)
    return supported_only(whole, support), support
