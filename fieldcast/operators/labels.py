"""Species floors, hour support and verified-zero labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.operators.outings import is_species


def species_floor(observations: DataFrame, min_detections: int = P.MIN_DETECTIONS) -> DataFrame:
    """Species with enough detections over all recorded outings.

    Distinct (outing, species) pairs come as one set per outing: the exchange
    then carries each outing id once instead of once per species.
    """
    sets = (observations.where(is_species(F.col("species_code")))
            .groupBy("sub_id").agg(F.collect_set("species_code").alias("seen")))
    return (sets.select(F.explode("seen").alias("species_code"))
            .groupBy("species_code").agg(F.count(F.lit(1)).alias("detections"))
            .where(F.col("detections") >= min_detections))


def species_array(species: DataFrame, column: str = "species_code") -> Column:
    """The species list as one sorted array, usable in any projection.

    A scalar subquery over one row, bounded by the checklist taxonomy (some
    ten thousand codes at most).
    """
    return species.select(F.sort_array(F.collect_set(column))).scalar()


def hour_support(table: DataFrame, min_per_hour: int = P.MIN_PER_HOUR) -> DataFrame:
    """Outings per hour bucket, and whether the hour passes the floor."""
    return (table.where(F.col("hr").isNotNull()).groupBy("hr").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("supported", F.col("n") >= min_per_hour))


def supported_only(table: DataFrame, support: DataFrame) -> DataFrame:
    """Outings in supported hours. The support table has at most 25 rows."""
    return table.join(support.where("supported").select("hr"), "hr", "left_semi")


def presence_absence(table: DataFrame, species: DataFrame) -> DataFrame:
    """One row per outing and qualifying species, y = 1 where it was seen.

    Each outing already carries its set of seen species, so the labels are an
    explode of a constant array in the same stage: no join on (outing, species)
    and no shuffle of the dense result.
    """
    return (table.withColumn("species_code", F.explode(species_array(species)))
            .withColumn("y", F.array_contains("seen", F.col("species_code")).cast("int"))
            .drop("seen"))


def wide_labels(table: DataFrame, species: list[str]) -> DataFrame:
    """The wide form: one ``y_<species>`` column per named species."""
    return table.select("*", *[F.array_contains("seen", s).cast("int").alias(f"y_{s}")
                               for s in species]).drop("seen")


def prevalence(table: DataFrame, species: DataFrame, top: int = 8) -> DataFrame:
    """Share and number of outings reporting each of the commonest species.

    "Commonest" ranks by detections over all recorded outings. Counts only the
    species present, then divides by the number of outings: absences never
    become rows.
    """
    best = species.orderBy(F.col("detections").desc(), "species_code").limit(top)
    n = table.agg(F.count(F.lit(1))).scalar()
    hits = (table.select(F.explode("seen").alias("species_code"))
            .groupBy("species_code").agg(F.count(F.lit(1)).alias("n_seen")))
    return (best.join(hits, "species_code", "left")
            .withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
            .withColumn("n_outings", n)
            .withColumn("prevalence", F.try_divide(F.col("n_seen").cast("double"), F.col("n_outings")))
            .select("species_code", "detections", "n_seen", "n_outings", "prevalence"))


def model_census(table: DataFrame) -> DataFrame:
    """Rows, days, hotspots and pooled personal sites of the model table.

    Counts visits per (site, date) first, so the distinct counts run on that
    much smaller frame and a busy site is combined map-side.
    """
    small = table.groupBy("loc_id", "is_hotspot", "obs_date").agg(F.count(F.lit(1)).alias("n"))
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.countDistinct("obs_date").alias("n_days"),
        F.countDistinct(F.when(F.col("is_hotspot"), F.col("loc_id"))).alias("n_hotspots"),
        F.countDistinct(F.when(~F.col("is_hotspot"), F.col("loc_id"))).alias("n_personal"))


def fitted_species(table: DataFrame, species: DataFrame,
                   min_detections: int = P.MIN_DETECTIONS) -> DataFrame:
    """Second floor: detections counted again on the filtered table."""
    hits = (table.select(F.explode("seen").alias("species_code"))
            .groupBy("species_code").agg(F.count(F.lit(1)).alias("n_det")))
    return (hits.join(species.select("species_code"), "species_code", "left_semi")
            .where(F.col("n_det") >= min_detections))
