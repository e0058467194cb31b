"""Fitted models as documents, as long tables and as published bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.operators.dedup import top_by

_TERM = "array<struct<term:string,value:double>>"


def _entries(column: Column, name) -> Column:
    """A map block as an array of (term, value)."""
    empty = F.array().cast(_TERM)
    return F.coalesce(F.transform(F.map_entries(column), lambda e: F.struct(
        name(e["key"]).alias("term"), e["value"].cast("double").alias("value"))), empty)


def _padded(prefix: str):
    return lambda k: F.format_string(prefix + "_%02d", k.cast("int"))


def coef_long(models: DataFrame) -> DataFrame:
    """Nested model documents to ``(species_code, term, value)``.

    ``models`` has species_code, the scalar terms, the maps hour, week, site
    and hour_support, and meta {detections, by_date, by_site}. All blocks go
    through one explode, so each document is read once.
    """
    scalars = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("value"))
                        for c in P.SCALAR_TERMS])
    detections = F.array(F.struct(F.lit("meta_detections").alias("term"),
                                  F.col("meta.detections").cast("double").alias("value")))
    metrics = [
        _entries(F.map_from_arrays(F.array(*[F.lit(k) for k in ("brier", "auc", "cal_mae")]),
                                   F.array(*[F.col(f"meta.{split}.{k}")
                                             for k in ("brier", "auc", "cal_mae")])),
                 lambda k, split=split: F.concat(F.lit(f"meta_{split}_"), k))
        for split in ("by_date", "by_site")]
    blocks = F.concat(
        scalars,
        _entries(F.col("hour"), _padded("hour")),
        _entries(F.col("week"), _padded("week")),
        _entries(F.col("site"), lambda k: F.concat(F.lit("site_"), k)),
        _entries(F.col("hour_support"), _padded("support")),
        detections, *metrics)
    return (models.select("species_code", F.inline(blocks))
            .where(F.col("value").isNotNull()))


def write_by_species(coefs: DataFrame, path: str) -> None:
    """Replace-by-key sink: species in ``coefs`` are rewritten, others stay."""
    (coefs.repartition("species_code").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("species_code").parquet(path))


def coef_bundle(coefs: DataFrame) -> DataFrame:
    """One JSON document per species, terms sorted by name."""
    return (coefs.groupBy("species_code")
            .agg(F.to_json(F.map_from_entries(F.sort_array(
                F.collect_list(F.struct("term", "value"))))).alias("document")))


def write_bundle(bundle: DataFrame, path: str) -> None:
    """``path/species_code=<code>/`` with one text document each."""
    (bundle.repartition("species_code").write.mode("overwrite")
     .partitionBy("species_code").text(path))


def coef_diff(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Two fits term by term: key sets, largest difference, within tolerance."""
    a = left.select("species_code", "term", F.col("value").alias("a"), F.lit(True).alias("in_a"))
    b = right.select("species_code", "term", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    d = F.abs(F.col("a") - F.col("b"))
    return (a.join(b, ["species_code", "term"], "full_outer")
            .agg(F.count_if(both).alias("n_common"),
                 F.count_if(F.col("in_b").isNull()).alias("n_only_left"),
                 F.count_if(F.col("in_a").isNull()).alias("n_only_right"),
                 F.max(F.when(both, d)).alias("max_abs_diff"),
                 F.count_if(both & (d > tolerance)).alias("n_beyond"))
            .withColumn("same_terms", (F.col("n_only_left") == 0) & (F.col("n_only_right") == 0))
            .withColumn("within", F.col("same_terms") & (F.col("n_beyond") == 0)))


def term_block(coefs: DataFrame, prefix: str, key: str, value: str, key_type: str = "string"
               ) -> DataFrame:
    """Terms ``<prefix>_<key>`` as a (species_code, key, value) lookup."""
    k = F.substring("term", len(prefix) + 2, 1 << 20)
    k = k.try_cast(key_type) if key_type != "string" else k
    return (coefs.where(F.col("term").startswith(prefix + "_"))
            .select("species_code", k.alias(key), F.col("value").alias(value)))


def heads(coefs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per species with everything but its own site effects.

    Scalar terms as columns ``b_<term>`` (0 when missing), and hour, support
    and week terms as arrays by number (null when missing). A scoring plan then
    needs one lookup by species, which the species list bounds, and finds the
    rest by position.
    """
    names = [*P.SCALAR_TERMS, *extra]
    term, value = F.col("term"), F.col("value")
    number = F.substring_index("term", "_", -1).try_cast("int")

    def block(prefix: str, size: int) -> tuple[Column, Column]:
        entries = F.collect_list(F.when(term.startswith(prefix + "_") & number.isNotNull(),
                                        F.struct(number.alias("k"), value.alias("v"))))
        at = F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                         lambda i: F.try_element_at(F.col(f"_{prefix}"), i))
        return F.map_from_entries(entries).alias(f"_{prefix}"), at.alias(f"{prefix}_terms")

    blocks = [block("hour", 25), block("support", 25), block("week", P.WEEKS_IN_YEAR)]
    scalars = [F.coalesce(F.max(F.when(term == n, value)), F.lit(0.0)).alias(f"b_{n}")
               for n in names]
    return (coefs.where(~term.startswith("site_") & ~term.startswith("meta_"))
            .groupBy("species_code").agg(*scalars, *[m for m, _ in blocks])
            .select("species_code", *[f"b_{n}" for n in names], *[at for _, at in blocks]))


def model_meta(coefs: DataFrame, hotspots: DataFrame, fitted_at: str, region: str,
               region_name: str) -> DataFrame:
    """When and where a fit is for, counts, modelled weeks and hours, and the
    covered box, as one row. ``hotspots`` is the finished dimension."""
    number = F.try_element_at(F.split("term", "_"), F.lit(2)).try_cast("int")
    c = coefs.where(F.col("term").startswith("week_") | F.col("term").startswith("hour_")
                    | (F.col("term") == "intercept"))
    of = lambda p: F.sort_array(F.collect_set(
        F.when(F.col("term").startswith(p), number)))
    return (c.agg(F.countDistinct("species_code").alias("species"),
                  of("week_").alias("modelled_weeks"), of("hour_").alias("modelled_hours"))
            .withColumn("hotspots", hotspots.agg(F.count(F.lit(1))).scalar())
            .withColumns({k: F.lit(v) for k, v in P.EXTENT.items()})
            .withColumns({"fitted_at": F.lit(fitted_at).cast("timestamp"), "region": F.lit(region),
                          "region_name": F.lit(region_name)}))


def hotspot_dim(coefs: DataFrame, names: DataFrame, checklists: DataFrame) -> DataFrame:
    """Modelled sites with name, coordinates and visits over all outings."""
    visits = checklists.groupBy("loc_id").agg(F.count(F.lit(1)).alias("n_checklists"))
    return (modelled_sites(coefs).join(names, "loc_id", "inner")
            .join(visits, "loc_id", "left")
            .select("loc_id", "name", "latitude", "longitude",
                    F.coalesce("n_checklists", F.lit(0)).alias("n_checklists")))


def modelled_sites(coefs: DataFrame) -> DataFrame:
    """Sites with their own coefficient in any model."""
    return (term_block(coefs, "site", "loc_id", "v").where(F.col("loc_id") != P.POOLED_SITE)
            .select("loc_id").distinct())


def hotspots_unmatched(coefs: DataFrame, names: DataFrame) -> DataFrame:
    """Modelled sites the name reference no longer lists."""
    return modelled_sites(coefs).join(names.select("loc_id"), "loc_id", "left_anti")


def refresh_dimension(dim: DataFrame, path: str) -> None:
    """Full refresh of a small published table."""
    dim.write.mode("overwrite").parquet(path)


def species_list(coefs: DataFrame, photos: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Modelled species with a display name and whether a photo exists.

    Names fall back from the photo record to the taxonomy to the code.
    """
    first = top_by(photos.select("species_code", F.col("common_name").alias("photo_name"),
                                 "has_main"), ["species_code"],
                   [F.col("has_main").desc_nulls_last(), F.col("photo_name").asc_nulls_last()])
    taxa = top_by(taxonomy.select("species_code", F.col("common_name").alias("taxon_name")),
                  ["species_code"], [F.col("taxon_name").asc_nulls_last()])
    return (coefs.select("species_code").distinct()
            .join(first, "species_code", "left").join(taxa, "species_code", "left")
            .select("species_code",
                    F.coalesce("photo_name", "taxon_name", "species_code").alias("common_name"),
                    F.coalesce("has_main", F.lit(False)).alias("has_photos"))
            .orderBy("common_name", "species_code"))
