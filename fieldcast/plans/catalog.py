"""Registered queries: each reads whole given tables through ``Domain``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import params as P
from fieldcast.functions import clock_hour, hour_bucket, snap, week_of
from fieldcast.operators import (answers, best, coefficients, community, evaluation, hourcoding, labels, modelling,
                                 outings, photos, requests, rolling, scoring, spatial, stores, weather)
from fieldcast.plans.bindings import Domain
from fieldcast.plans.features import fit_table, model_table, outing_features
from fieldcast.session import scratch_path, stored
from fieldcast.sources import documents, tables
from fieldcast.streaming import ingest

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
DIGITS = 6
# means of short decimals can end in a tie at six digits
FINER = dict.fromkeys(("calibration_table", "calibration_mae", "eval_metrics", "eval_summary",
                       "weather_span", "weather_dedup", "weather_unzip", "forecast_span"), 9)


def query(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Dates and times as text, arrays as joined text, doubles rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name, fn):
        return lambda spark, sf_dir: present(fn(Domain(spark, sf_dir)), FINER.get(name, DIGITS))

    return {name: bind(name, fn) for name, fn in QUERIES.items()}


# -- outings and predictors ---------------------------------------------------
@query
def eligible_outings(d: Domain) -> DataFrame:
    return outings.eligible_outings(d.checklists, d.locations)


@query
def richness(d: Domain) -> DataFrame:
    base = d.checklists.where(outings.is_eligible()).select("sub_id", "loc_id")
    return outings.with_richness(base, d.observations).select("sub_id", "loc_id", "richness")


@query
def grid_snap(d: Domain) -> DataFrame:
    return outings.with_cell(d.locations).select("loc_id", "clat", "clon")


@query
def clock_hour_query(d: Domain) -> DataFrame:
    return d.checklists.select("sub_id", "obs_time", clock_hour(F.col("obs_time")).alias("hour"))


QUERIES["clock_hour"] = QUERIES.pop("clock_hour_query")


@query
def outing_span(d: Domain) -> DataFrame:
    e = outings.eligible_outings(d.checklists, d.locations)
    return outings.outing_span(e).select("sub_id", "start_ts", "end_ts", "span_from", "span_to")


@query
def derived_features(d: Domain) -> DataFrame:
    return outings.with_predictors(d.checklists.where(outings.is_eligible())).select(
        "sub_id", "doy", "log_dur", "log_dist", "traveling")


@query
def hour_week_bucket(d: Domain) -> DataFrame:
    return d.checklists.select(
        "sub_id", hour_bucket(clock_hour(F.col("obs_time"))).alias("hr"),
        week_of(F.col("obs_date")).alias("week"))


@query
def site_pooling(d: Domain) -> DataFrame:
    e = outings.with_site(outings.eligible_outings(d.checklists, d.locations))
    return e.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query
def in_coverage(d: Domain) -> DataFrame:
    return scoring.outside_area(d.pins).select("point_id", "in_coverage", "reason")


@query
def validate_outings(d: Domain) -> DataFrame:
    return outings.validate_outings(d.logged).select("outing_id", "valid", "problems")


# -- weather ------------------------------------------------------------------
@query
def weather_span(d: Domain) -> DataFrame:
    f = outing_features(d.checklists, d.locations)
    return weather.with_weather(f, d.weather).select(
        "sub_id", "clat", "clon", "hour", "wind_max", "precip_sum", "temp_mean", "cloud_mean",
        "humid_mean", "n_wx_hours")


@query
def weather_gap(d: Domain) -> DataFrame:
    # a cache last filled on the 20th, for every outing on record
    cached = d.weather.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return weather.weather_gap(outing_features(d.checklists, d.locations), cached)


@query
def weather_gap_ranges(d: Domain) -> DataFrame:
    return weather.gap_ranges(QUERIES["weather_gap"](d))


@query
def weather_dedup(d: Domain) -> DataFrame:
    new = d.hourly(d.table("events").where(F.col("event_type").isin("view", "click")))
    return weather.weather_dedup(d.weather, new.select(*reversed(new.columns)))


@query
def weather_gate(d: Domain) -> DataFrame:
    return weather.weather_gate(
        weather.with_weather(outing_features(d.checklists, d.locations), d.weather))


@query
def weather_spread(d: Domain) -> DataFrame:
    return weather.weather_spread(
        weather.with_weather(outing_features(d.checklists, d.locations), d.weather))


@query
def weather_unzip(d: Domain) -> DataFrame:
    rows = d.weather.withColumn("date", F.col("ts").cast("date"))
    packed = F.sort_array(F.collect_list(F.struct("ts", "temp", "precip", "wind", "cloud", "humid")))
    names = {"temp": "temperature_2m", "precip": "precipitation", "wind": "wind_speed_10m",
             "cloud": "cloud_cover", "humid": "relative_humidity_2m"}
    # one document per cell and day, at most 24 entries; pressure left out
    docs = (rows.groupBy("clat", "clon", "date").agg(packed.alias("a"))
            .select("clat", "clon", F.to_json(F.struct(F.struct(
                F.transform("a", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm"))
                .alias("time"),
                *[F.col(f"a.{k}").alias(v) for k, v in names.items()]).alias("hourly")))
                .alias("json")))
    docs = documents.parse(docs, "json", documents.HOURLY_DOC)
    return documents.weather_unzip(docs, ["clat", "clon"])


# -- labels and support -------------------------------------------------------
@query
def presence_absence(d: Domain) -> DataFrame:
    t = d.model.select("sub_id", "seen")
    return labels.presence_absence(t, labels.species_floor(d.observations))


@query
def species_floor(d: Domain) -> DataFrame:
    return labels.species_floor(d.observations)


@query
def fitted_species(d: Domain) -> DataFrame:
    table, _ = fit_table(d.model, drop_without_weather=True)
    return labels.fitted_species(table, labels.species_floor(d.observations), 50)


@query
def hour_support(d: Domain) -> DataFrame:
    return labels.hour_support(outing_features(d.checklists, d.locations), 100)


@query
def prevalence(d: Domain) -> DataFrame:
    return labels.prevalence(d.model, labels.species_floor(d.observations))


@query
def model_census(d: Domain) -> DataFrame:
    f = outing_features(d.checklists, d.locations)
    return labels.model_census(labels.supported_only(f, labels.hour_support(f, 100)))


# -- ingest and stores --------------------------------------------------------
def _checklist_docs(d: Domain) -> DataFrame:
    """Landed documents, one per outing, as JSON text."""
    items = (d.observations.groupBy("sub_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("species_code").alias("speciesCode"), F.col("at_least").alias("howManyAtleast"),
        F.col("at_most").alias("howManyAtmost")))).alias("obs")))
    c = d.checklists.join(items, "sub_id", "left")
    return c.select("status", F.to_json(F.struct(
        F.col("sub_id").alias("subId"), F.col("loc_id").alias("locId"),
        F.concat_ws(" ", F.col("obs_date").cast("string"), "obs_time").alias("obsDt"),
        F.col("duration_hrs").alias("durationHrs"), F.col("distance_km").alias("effortDistanceKm"),
        F.col("n_observers").alias("numObservers"), F.col("protocol_id").alias("protocolId"),
        F.col("all_reported").alias("allObsReported"), F.col("observer").alias("userDisplayName"),
        "obs")).alias("json"))


def _parsed(d: Domain) -> DataFrame:
    return documents.parse(_checklist_docs(d), "json", documents.CHECKLIST_DOC)


@query
def flatten_checklists(d: Domain) -> DataFrame:
    read = F.lit("2024-02-05 06:00:00").cast("timestamp")
    return documents.checklist_rows(_parsed(d), "R1", read)


@query
def flatten_observations(d: Domain) -> DataFrame:
    return documents.observation_rows(_parsed(d))


@query
def feed_locations(d: Domain) -> DataFrame:
    k = F.substring("sub_id", 2, 20).try_cast("long")
    rows = d.checklists.withColumn("k", k).join(d.locations, "loc_id")
    # one feed per day and observer; coordinates wobble between entries
    loc = F.struct(F.col("loc_id").alias("locId"),
                   (F.col("lat") + (k % 3) / F.lit(1000.0)).alias("latitude"),
                   F.col("lon").alias("longitude"),
                   F.when(k % 5 != 0, F.col("is_hotspot")).alias("isHotspot"))
    packed = F.sort_array(F.collect_list(F.struct("k", F.struct(
        F.col("sub_id").alias("subId"), loc.alias("loc")).alias("item"))))
    feeds = (rows.groupBy("obs_date", "observer").agg(packed.alias("a"))
             .select("obs_date", "observer", F.to_json(F.col("a.item")).alias("json")))
    feeds = documents.parse(feeds, "json", documents.FEED_DOC)
    return documents.feed_locations(feeds, ["obs_date", "observer"])


STORED = ["sub_id", "loc_id", "obs_date", "duration_hrs"]


def _two_batches(d: Domain) -> tuple[DataFrame, DataFrame]:
    c = d.checklists
    return (c.where(F.col("status") != "P").select(*STORED),
            c.where(F.col("status") != "O").select(*STORED))


@query
def idempotent_append(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "append")
    a, b = _two_batches(d)
    for batch in (a, b, b):
        tables.append_new(batch, path, ["sub_id"], ["obs_date"])
    return d.spark.read.parquet(path).select(*STORED)


@query
def natural_key_merge(d: Domain) -> DataFrame:
    a, b = _two_batches(d)
    return stores.merge_by_key(a, b.select(*reversed(STORED)), ["sub_id"], "checklists")


@query
def merge_report(d: Domain) -> DataFrame:
    a, b = _two_batches(d)
    return stores.merge_report("checklists", a, b, ["sub_id"])


def _two_stores(d: Domain) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Two stores that share a third of their rows, columns in another order.

    The observations are written first: otherwise both sides of the merge would
    aggregate them in the tasks that also sort and join them.
    """
    loc, obs = [F.substring(c, 2, 20).try_cast("long") % 3 for c in ("loc_id", "sub_id")]
    a, b = _two_batches(d)
    locations = d.locations
    seen = stored(d.observations.select("sub_id", "species_code", "how_many"), "observations")
    local = {"checklists": a, "locations": locations.where(loc != 0), "observations": seen.where(obs != 0)}
    other = {"checklists": b, "locations": locations.where(loc != 1), "observations": seen.where(obs != 1)}
    return local, {k: v.select(*reversed(v.columns)) for k, v in other.items()}


@query
def store_merge(d: Domain) -> DataFrame:
    """Rows of the merged stores as (table, key), with the values they carry."""
    merged = stores.merge_stores(*_two_stores(d))
    texts = [merged[t].select(F.lit(t).alias("table_name"), F.concat_ws("/", *keys).alias("key"),
                              F.col(v).cast("double").alias("value"))
             for t, keys, v in (("checklists", ["sub_id"], "duration_hrs"), ("locations", ["loc_id"], "lat"),
                                ("observations", ["sub_id", "species_code"], "how_many"))]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])


@query
def store_merge_report(d: Domain) -> DataFrame:
    return stores.merge_stores_report(*_two_stores(d))


@query
def insert_sites(d: Domain) -> DataFrame:
    """Sites of the feeds go into a store that has the public ones already."""
    path = scratch_path(d.spark, "sites")
    d.locations.where("is_hotspot").write.parquet(path)
    report = stores.insert_sites(QUERIES["feed_locations"](d), path)
    return report.withColumn("n_stored", d.spark.read.parquet(path).agg(
        F.countDistinct("loc_id")).scalar())


@query
def unresolved_days(d: Domain) -> DataFrame:
    return stores.unresolved_days(d.checklists, d.locations)


@query
def site_census(d: Domain) -> DataFrame:
    return stores.site_census(d.checklists, d.locations)


@query
def calendar_gap(d: Domain) -> DataFrame:
    return stores.calendar_gap(d.checklists, "2023-10-20", "2024-03-31", as_of="2024-03-20")


@query
def backfill_plan(d: Domain) -> DataFrame:
    gap = stores.calendar_gap(d.checklists, "2023-10-20", "2024-03-31", as_of="2024-03-20")
    return stores.backfill_plan(gap, max_days=80)


@query
def truncated_days(d: Domain) -> DataFrame:
    return stores.truncated_days(d.checklists, 510)


@query
def settled_window(d: Domain) -> DataFrame:
    return stores.settled_window(d.checklists, "2024-02-05").select("sub_id", "obs_date")


@query
def table_census(d: Domain) -> DataFrame:
    return stores.require_rows(stores.table_census(d.checklists, d.observations))


def _daily(d: Domain) -> DataFrame:
    n = F.count(F.lit(1))
    return d.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.when(n % 5 != 0, F.round(F.max("o_totalprice") / 1000, 3)).alias("wind_max"),
        F.round(F.sum("o_totalprice") / 10000, 3).alias("precip"),
        F.round(F.avg("o_totalprice") / 10000, 3).alias("temp_mean"))


@query
def extreme_days(d: Domain) -> DataFrame:
    return stores.extreme_days(_daily(d))


@query
def extreme_days_documents(d: Domain) -> DataFrame:
    """The same from landed documents, one a year."""
    packed = F.sort_array(F.collect_list(F.struct("date", "wind_max", "precip", "temp_mean")))
    block = F.struct(F.transform("a", lambda x: x["date"].cast("string")).alias("time"),
                     *[F.col(f"a.{n}").alias(f) for f, n in documents.DAILY_FIELDS.items()])
    docs = (_daily(d).groupBy(F.year("date").alias("of_year")).agg(packed.alias("a"))
            .select("of_year", F.to_json(F.struct(block.alias("daily"))).alias("json")))
    docs = documents.parse(docs, "json", documents.DAILY_DOC)
    return stores.extreme_days(documents.weather_unzip(docs, ["of_year"], "daily"))


# -- coefficients -------------------------------------------------------------
@query
def coef_long(d: Domain) -> DataFrame:
    return coefficients.coef_long(d.models)


@query
def coef_replace(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "coef")
    coefficients.write_by_species(d.coefs, path)
    coefficients.write_by_species(d.refit, path)
    return d.spark.read.schema("species_code string, term string, value double").parquet(path)


@query
def coef_bundle(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "bundle")
    coefficients.write_bundle(coefficients.coef_bundle(d.coefs), path)
    # read the published documents back, one per species
    text = d.spark.read.schema("document string, species_code string").text(path, wholetext=True)
    terms = F.from_json("document", "map<string,double>")
    return text.select("species_code", F.explode(terms).alias("term", "value"))


@query
def coef_diff(d: Domain) -> DataFrame:
    return coefficients.coef_diff(d.coefs, d.refit)


@query
def hotspot_dim(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "hotspots")
    coefficients.refresh_dimension(
        coefficients.hotspot_dim(d.coefs, d.site_names, d.checklists), path)
    return d.spark.read.parquet(path)


@query
def hotspots_unmatched(d: Domain) -> DataFrame:
    return coefficients.hotspots_unmatched(d.coefs, d.site_names)


def _name_sources(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Photo names for a third of the species, taxonomy names for half."""
    sno = F.col("sno")
    shot = (d.photos.where("is_curated and licence is not null").groupBy("taxon_id")
            .agg(F.count(F.lit(1)).alias("n")))
    with_photo = (d.species.withColumn("taxon_id", (sno - 3).cast("long"))
                  .join(shot, "taxon_id", "left"))
    photo = with_photo.where(sno % 3 == 0).select(
        "species_code", F.concat(F.lit("photo name "), sno.cast("string")).alias("common_name"),
        F.col("n").isNotNull().alias("has_main"))
    taxa = d.species.where(sno % 2 == 0).select(
        "species_code", F.concat(F.lit("Listed "), sno.cast("string")).alias("common_name"))
    return photo, taxa


@query
def species_list(d: Domain) -> DataFrame:
    photo, taxa = _name_sources(d)
    return coefficients.species_list(d.coefs, photo, taxa)


@query
def model_meta(d: Domain) -> DataFrame:
    # the run's time and region are told, not taken from the clock
    dim = coefficients.hotspot_dim(d.coefs, d.site_names, d.checklists)
    return coefficients.model_meta(d.coefs, dim, fitted_at="2024-02-05 06:00:00", region="R1",
                                   region_name="Region one")


# -- forecast -----------------------------------------------------------------
@query
def forecast_span(d: Domain) -> DataFrame:
    return d.spans(2.5)


@query
def unavailable(d: Domain) -> DataFrame:
    days = d.spans().select("day").distinct()
    cells = (days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
             .withColumn("week", week_of(F.col("day")))
             .withColumn("species_code", F.explode(labels.species_array(d.coefs))))
    return scoring.unavailable(cells, d.coefs).select("species_code", "day", "hour", "reason")


@query
def score_grid(d: Domain) -> DataFrame:
    return d.grid.select("species_code", "loc_id", "day", "hour", "probability", "reason",
                         "has_site_effect")


def _asked(d: Domain) -> tuple:
    return d.coefs, d.spans(), d.hotspots, ["clat", "clon"]


def _snapshots(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Two forecasts: the second starts two days later and has more wind at times."""
    first = stored(d.weather, "weather")
    gust = F.when((F.dayofmonth("ts") + F.hour("ts")) % 9 == 0, 3).otherwise(0)
    second = first.where("ts >= timestamp_ntz'2024-01-03 00:00:00'").withColumn("wind", F.col("wind") + gust)
    return tuple(stored(scoring.forecast_span(w, ["clat", "clon"], 1.0), "snapshot") for w in (first, second))


def _rolled(d: Domain) -> tuple[str, DataFrame]:
    area, root = ["clat", "clon"], rolling.new_store(d.spark)
    first, second = _snapshots(d)
    rolling.roll(root, 1, d.coefs, None, first, d.hotspots, area)
    return root, rolling.roll(root, 2, d.coefs, first, second, d.hotspots, area)


@query
def rolling_forecast(d: Domain) -> DataFrame:
    """The grid after a second snapshot, of which only changed slots were scored."""
    return rolling.current(d.spark, _rolled(d)[0], 2, ["clat", "clon"]).select(
        "species_code", "loc_id", "day", "hour", "probability", "reason")


@query
def rolling_slots(d: Domain) -> DataFrame:
    """Slots per area and day, and how many of them the second snapshot scored."""
    return _rolled(d)[1]


@query
def drivers(d: Domain) -> DataFrame:
    return scoring.drivers(d.coefs, best.best_window(
        *_asked(d), carry=["site_effect", *scoring.WEATHER]))


@query
def best_window(d: Domain) -> DataFrame:
    return best.best_window(*_asked(d))


@query
def best_hotspots(d: Domain) -> DataFrame:
    return best.best_hotspots(*_asked(d)).select(
        "species_code", "day", "hour", "rank", "loc_id", "probability", "lo", "hi", "n_scored", "t")


@query
def species_shortlist(d: Domain) -> DataFrame:
    return scoring.species_shortlist(d.coefs, d.spans(), d.hotspots, ["clat", "clon"])


@query
def weather_effect(d: Domain) -> DataFrame:
    return scoring.weather_effect(d.coefs, best.best_hotspots(*_asked(d), k=1))


@query
def week_coverage(d: Domain) -> DataFrame:
    return scoring.week_coverage(d.coefs, "2024-01-20")


@query
def nearest_weeks(d: Domain) -> DataFrame:
    return scoring.nearest_weeks(d.coefs)


# -- forecasts on request -----------------------------------------------------
def _asked_grid(d: Domain) -> DataFrame:
    places = d.hotspots.select("loc_id", F.col("lat").alias("latitude"),
                               F.col("lon").alias("longitude"))
    return requests.forecast_requests(d.requests, d.coefs, d.weather, places, ["clat", "clon"])


@query
def forecast_request(d: Domain) -> DataFrame:
    return _asked_grid(d).select("request_id", "species_code", "loc_id", "has_site_effect", "day",
                                 "hour", "reason", "probability")


@query
def request_summary(d: Domain) -> DataFrame:
    return requests.request_summary(_asked_grid(d), d.coefs)


@query
def request_drivers(d: Domain) -> DataFrame:
    return requests.request_drivers(_asked_grid(d), d.coefs)


# -- evaluation ---------------------------------------------------------------
GROUP = ["split", "species_code"]


@query
def group_holdout(d: Domain) -> DataFrame:
    return evaluation.group_holdout(d.model, "loc_id")


@query
def eval_metrics(d: Domain) -> DataFrame:
    return evaluation.eval_metrics(d.scored, GROUP)


@query
def calibration_table(d: Domain) -> DataFrame:
    return evaluation.calibration_table(d.scored, GROUP)


@query
def calibration_mae(d: Domain) -> DataFrame:
    return evaluation.calibration_mae(evaluation.calibration_table(d.scored, GROUP), GROUP)


@query
def eval_summary(d: Domain) -> DataFrame:
    return evaluation.eval_summary(evaluation.eval_metrics(d.scored, GROUP))


# -- fitted models ------------------------------------------------------------
def _fit_inputs(d: Domain) -> tuple[DataFrame, DataFrame, list[str]]:
    """Checkpointed fit table, hour counts and the species to fit."""
    full = d.model.select("sub_id", "loc_id", "obs_date", "lat", "lon", "hour", "doy", "hr", "week",
                          "site", *P.NUMERIC, "seen", "n_wx_hours", "humid_mean")
    # the given events leave some outings without weather
    table, support = fit_table(stored(full, "model"), drop_without_weather=True)
    listed = labels.fitted_species(table, labels.species_floor(d.observations))
    # bounded by the species list; commonest first
    codes = [r["species_code"] for r in
             listed.orderBy(F.col("n_det").desc(), "species_code").collect()]
    return table, support, codes


@query
def fit_ridge(d: Domain) -> DataFrame:
    table, support, codes = _fit_inputs(d)
    if not codes:
        return d.coefs.limit(0)
    return modelling.fit_ridge(table, codes, support)


@query
def evaluate_models(d: Domain) -> DataFrame:
    table, _, codes = _fit_inputs(d)
    if not codes:
        return evaluation.eval_metrics(d.scored.limit(0), GROUP)
    by_site = modelling.evaluate(table, codes, "site")
    return by_site.unionByName(modelling.evaluate(table, codes, "date"))


@query
def holdout_metrics_check(d: Domain) -> DataFrame:
    """Metrics of both hold-outs where the fitted scores have a closed form."""
    table, _, codes = _fit_inputs(d)
    if not codes:
        return evaluation.eval_metrics(d.scored.limit(0), GROUP)
    return modelling.evaluate(table, codes, "site", modelling.LEVEL_DESIGN).unionByName(
        modelling.evaluate(table, codes, "date", modelling.LEVEL_DESIGN))


@query
def calibrate_models(d: Domain) -> DataFrame:
    """Calibration of the site-free variant at held-out sites."""
    table, _, codes = _fit_inputs(d)
    if not codes:
        return evaluation.calibration_table(d.scored.limit(0), ["species_code"])
    scores = modelling.holdout_scores(table, codes, "loc_id", modelling.CALIBRATION_DESIGN)
    return evaluation.calibration_table(stored(scores, "scores"), ["species_code"])


@query
def calibrate_metrics(d: Domain) -> DataFrame:
    """Brier score, AUC, average precision and mean gap of the site-free variant."""
    table, _, codes = _fit_inputs(d)
    if not codes:
        return modelling.verdicts(evaluation.eval_metrics(d.scored.limit(0), ["species_code"]))
    scores = modelling.holdout_scores(table, codes, "loc_id", modelling.CALIBRATION_DESIGN)
    return modelling.verdicts(evaluation.eval_metrics(stored(scores, "scores"), ["species_code"]))


@query
def refit_publish(d: Domain) -> DataFrame:
    """Fit, both hold-outs, replace by species, then score with what is published.

    Term names of all species, with the values that are counts or were kept
    from before; and the slots per reason of the forecast from these terms.
    """
    table, support, codes = _fit_inputs(d)
    path = scratch_path(d.spark, "published")
    coefficients.write_by_species(d.coefs, path)
    if codes:
        coefficients.write_by_species(modelling.refit(table, codes, support), path)
    published = d.spark.read.schema("species_code string, term string, value double").parquet(path)
    told = (~F.col("species_code").isin(codes) | F.col("term").startswith("support_")
            | (F.col("term") == "meta_detections"))
    terms = published.select("species_code", "term", F.when(told, F.col("value")).alias("value"))
    grid = scoring.score_grid(published, d.spans(), d.hotspots, ["clat", "clon"])
    scored = F.col("reason").isNotNull() | F.col("probability").between(0, 1)
    slots = (grid.where(scored).groupBy("species_code", F.concat(
        F.lit("slots_"), F.coalesce("reason", F.lit("scored"))).alias("term"))
        .agg(F.count(F.lit(1)).cast("double").alias("value")))
    return terms.unionByName(slots)


@query
def fit_ridge_check(d: Domain) -> DataFrame:
    """Every ridge model's zero gradient, term by term, against plain counts."""
    table, _, codes = _fit_inputs(d)
    if not codes:
        return d.coefs.limit(0).select("species_code", "term", F.lit(0).cast("long").alias("n_rows"),
                                       F.col("value").alias("fitted"))
    return modelling.balance(table, modelling.fit_coefficients(table, codes))


@query
def holdout_check(d: Domain) -> DataFrame:
    """Held-out counts and the trained side's balance, for all three hold-outs."""
    table, _, codes = _fit_inputs(d)
    parts = [("by_site", "loc_id", modelling.Design()), ("by_date", "obs_date", modelling.Design()),
             ("calibration", "loc_id", modelling.CALIBRATION_DESIGN)]
    checks = [modelling.holdout_balance(table, codes, group, design).withColumn("split", F.lit(name))
              for name, group, design in (parts if codes else [])]
    if not checks:
        n = F.lit(0).cast("long")
        return d.coefs.limit(0).select("species_code", n.alias("n_test"), n.alias("pos_test"),
                                       n.alias("n_train"), F.col("value").alias("fitted_train"),
                                       F.lit("").alias("split"))
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def _commonest(d: Domain, table: DataFrame) -> str:
    r = (table.select(F.explode("seen").alias("s")).groupBy("s").count()
         .orderBy(F.col("count").desc(), "s").first())
    return r["s"] if r else ""


def _hour_table(d: Domain) -> tuple[DataFrame, str]:
    full = stored(d.model.select("seen", "hr", "hour", "doy", "log_dur", "log_dist", "wind_max",
                                 "temp_mean", "precip_sum", "cloud_mean", "humid_mean",
                                 "n_wx_hours"), "model")
    table = full.where(~weather.lacks_weather())
    return table, _commonest(d, table)


@query
def hour_coding(d: Domain) -> DataFrame:
    return hourcoding.hour_coding(*_hour_table(d))


@query
def odds_ratios(d: Domain) -> DataFrame:
    return hourcoding.odds_ratios(*_hour_table(d))


@query
def hour_coding_check(d: Domain) -> DataFrame:
    return hourcoding.hour_balance(*_hour_table(d))


@query
def hour_contrasts(d: Domain) -> DataFrame:
    return hourcoding.hour_contrasts(*_hour_table(d))


@query
def worked_example(d: Domain) -> DataFrame:
    return hourcoding.worked_example(*_hour_table(d))


@query
def spline_values(d: Domain) -> DataFrame:
    """The published spline basis at every day and hour of the fitted outings."""
    values = hourcoding.spline_values(_hour_table(d)[0])
    return values.where("round(value, 9) <> 0")


# -- places and people --------------------------------------------------------
def _places(d: Domain) -> DataFrame:
    return d.hotspots.select("loc_id", F.col("lat").alias("latitude"),
                             F.col("lon").alias("longitude"))


@query
def snap_hotspot(d: Domain) -> DataFrame:
    return spatial.snap_hotspot(d.pins, _places(d)).select("point_id", "loc_id", "distance_km")


@query
def nearby_ranked(d: Domain) -> DataFrame:
    return spatial.nearby_ranked(d.pins, _places(d), best.best_probability(*_asked(d)))


@query
def recent_nearby(d: Domain) -> DataFrame:
    return spatial.recent_nearby(d.sightings, "2024-01-29")


@query
def recent_radius(d: Domain) -> DataFrame:
    return spatial.recent_around(d.sightings, d.pins.select("point_id", "lat", "lon"), "2024-01-29")


@query
def shared_answers(d: Domain) -> DataFrame:
    """Three rounds of questions: answers hold three days and are shared by place."""
    root = scratch_path(d.spark, "answers")
    points = d.pins.select("point_id", "lat", "lon")
    number = F.try_to_number(F.regexp_extract("point_id", r"(\d+)$", 1), F.lit("9" * 12))
    seen = stored(d.sightings, "sightings")
    answers.ask_recent(points.where(number % 50 < 15), seen, root, "2024-01-20")
    answers.ask_recent(points.where(number % 50 < 30), seen, root, "2024-01-23")
    return answers.ask_recent(points, seen, root, "2024-01-24")


@query
def user_lists(d: Domain) -> DataFrame:
    return community.user_lists(d.checklists, d.observations)


@query
def user_summary(d: Domain) -> DataFrame:
    return community.user_summary(d.checklists, d.observations)


def _board(d: Domain) -> DataFrame:
    return community.leaderboard(d.model.where(~weather.lacks_weather()), d.coefs)


@query
def leaderboard(d: Domain) -> DataFrame:
    return _board(d)


@query
def leaderboard_top(d: Domain) -> DataFrame:
    return community.top_of_leaderboard(_board(d), 20).select(
        "month", "rank", "observer", "efficiency")


# -- photos -------------------------------------------------------------------
@query
def photo_clean(d: Domain) -> DataFrame:
    docs = d.table("documents").select(
        F.col("doc_id").alias("photo_id"),
        F.concat(F.lit("https://photos.example.org/"), "source", F.lit("/square.jpg")).alias("url"),
        F.when(F.col("lang") != "fr", "cc-by").alias("licence"), F.col("text").alias("attribution"))
    return photos.photo_clean(docs)


@query
def photo_top(d: Domain) -> DataFrame:
    return photos.photo_top(d.photos)


@query
def photo_coverage(d: Domain) -> DataFrame:
    return photos.photo_coverage(photos.photo_top(d.photos))


@query
def photo_documents(d: Domain) -> DataFrame:
    docs = photos.photo_documents(photos.photo_top(d.photos))
    return docs.select("taxon_id", F.col("main.url").alias("main_urls"),
                       F.array_sort(F.map_keys("months")).alias("months"),
                       F.col("female.url").alias("female_url"))


def _taxa(d: Domain) -> tuple[DataFrame, DataFrame]:
    part = d.table("part")
    names = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("scientific_name"))
    # the taxon list knows most parents and some full names
    taxa = (part.groupBy("p_name").agg(F.min("p_partkey").alias("taxon_id"))
            .select(F.col("p_name").alias("scientific_name"), "taxon_id")
            .unionByName(part.where("p_type = 'SMALL'").select(
                F.concat_ws(" ", "p_name", "p_brand").alias("scientific_name"),
                F.col("p_partkey").alias("taxon_id"))))
    return names, taxa


@query
def binomial_match(d: Domain) -> DataFrame:
    return photos.match_taxa(*_taxa(d)).select("p_partkey", "binomial", "taxon_id")


# -- stream -------------------------------------------------------------------
@query
def stream_ingest(d: Domain) -> DataFrame:
    root = scratch_path(d.spark, "stream")
    docs = stored(_checklist_docs(d), "docs")
    for part in (docs.where("status <> 'P'"), docs.where("status <> 'O'")):
        part.select("json").write.mode("append").text(f"{root}/landing")
    ingest.ingest(d.spark, f"{root}/landing", f"{root}/store", f"{root}/checkpoint", "R1",
                  files_per_trigger=8).awaitTermination()
    lists = tables.read_table(d.spark, f"{root}/store/checklists", tables.CHECKLISTS)
    seen = tables.read_table(d.spark, f"{root}/store/observations", tables.OBSERVATIONS)
    per = seen.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return (lists.join(per, "sub_id", "left")
            .select("sub_id", "loc_id", "obs_date", "richness",
                    F.coalesce("n_obs", F.lit(0)).alias("n_obs")))


@query
def settled_counts(d: Domain) -> DataFrame:
    """Settled days of a stream: outings land in waves of ten days, some a wave or
    two late, some again."""
    root = scratch_path(d.spark, "settled")
    k = F.substring(F.get_json_object("json", "$.subId"), 2, 20).try_cast("long")
    day = F.dayofmonth(F.to_date(F.substring(F.get_json_object("json", "$.obsDt"), 1, 10)))
    late = F.when(k % 11 == 0, 2).when(k % 7 == 0, 1).otherwise(0)
    wave = F.floor((day - 1) / 10) + late
    waves = F.when(k % 13 == 0, F.array(wave, wave + 1)).otherwise(F.array(wave))
    # a folder per wave, so each is read once
    (_checklist_docs(d).select("json", F.explode(waves).alias("wave"))
     .write.partitionBy("wave").parquet(f"{root}/filed"))
    docs = d.spark.read.schema("json string, wave bigint").parquet(f"{root}/filed")
    for w in range(6):
        docs.where(F.col("wave") == w).select("json").write.mode("append").text(f"{root}/landing")
        ingest.settle(d.spark, f"{root}/landing", f"{root}/settled", f"{root}/checkpoint", "R1",
                      files_per_trigger=100_000).awaitTermination()
    return d.spark.read.schema("obs_date date, n bigint").parquet(f"{root}/settled")


@query
def ingest_rejects(d: Domain) -> DataFrame:
    """Documents cut short or without an outing land among whole ones, twice."""
    root = scratch_path(d.spark, "rejects")
    sub_id = F.get_json_object("json", "$.subId")
    docs = stored(_checklist_docs(d).select(
        "json", sub_id.alias("sub_id"),
        (F.substring(sub_id, 2, 20).try_cast("long") % 20).alias("k")), "docs")
    sent = docs.select(F.when(F.col("k") == 0, F.concat(F.lit('{"subId":"'), "sub_id", F.lit('","loc')))
                       .when(F.col("k") == 1, F.concat(F.lit('{"locId":"'), "sub_id", F.lit('"}')))
                       .otherwise(F.col("json")).alias("json"))
    for _ in range(2):
        sent.write.mode("append").text(f"{root}/landing")
        ingest.ingest(d.spark, f"{root}/landing", f"{root}/store", f"{root}/checkpoint", "R1",
                      files_per_trigger=8).awaitTermination()
    bad = d.spark.read.schema("document string, file string").parquet(f"{root}/store/rejects")
    kept = tables.read_table(d.spark, f"{root}/store/checklists", tables.CHECKLISTS)
    return (bad.select("document").distinct().withColumn("stored", F.lit(False))
            .unionByName(kept.select(F.col("sub_id").alias("document"), F.lit(True).alias("stored"))))


@query
def model_wide(d: Domain) -> DataFrame:
    """The wide model table, one 0/1 column per qualifying species."""
    floor = labels.species_floor(d.observations, 100)
    # the column list: bounded by the species list
    codes = sorted(r["species_code"] for r in floor.select("species_code").collect())
    t = model_table(d.checklists, d.locations, d.observations, d.weather)
    return labels.wide_labels(t.select("sub_id", "richness", "hr", "week", "site", "seen"), codes)
