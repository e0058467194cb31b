"""Photo records: licence filter, clean-up and the best one per slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.operators.dedup import top_by


# Every character counted as white space, beyond ASCII too.
WHITE_SPACE = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def one_line(text: Column) -> Column:
    """Runs of white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " "))


def photo_clean(photos: DataFrame) -> DataFrame:
    """Licensed photos with a mid-size URL and a one-line attribution.

    No licence means all rights reserved, so such a photo is dropped.
    """
    return (photos.where(F.col("licence").isNotNull() & (F.col("licence") != ""))
            .withColumn("url", F.replace("url", F.lit("/square."), F.lit("/medium.")))
            .withColumn("attribution", one_line(F.col("attribution"))))


def binomial(name: Column) -> Column:
    """Genus and species of a scientific name, without subspecies."""
    return F.substring_index(one_line(name), " ", 2)


def match_taxa(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """Taxon id by full scientific name, else by the first two words of it."""
    one = top_by(taxa, ["scientific_name"], [F.col("taxon_id")])
    full = one.select(F.col("scientific_name"), F.col("taxon_id").alias("full_id"))
    two = one.select(F.col("scientific_name").alias("binomial"), F.col("taxon_id").alias("two_id"))
    return (names.withColumn("binomial", binomial(F.col("scientific_name")))
            .join(full, "scientific_name", "left").join(two, "binomial", "left")
            .withColumn("taxon_id", F.coalesce("full_id", "two_id")).drop("full_id", "two_id"))


def curated(photos: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` usable curated photos per taxon, in the given order."""
    return top_by(photo_clean(photos), ["taxon_id"], [F.col("position"), F.col("photo_id")],
                  k, "rank")


def best_voted(photos: DataFrame, slot: list[str], licences=P.USABLE_LICENCES) -> DataFrame:
    """Best-voted research-grade photo under a usable licence, per slot."""
    usable = photos.where((F.col("quality_grade") == "research")
                          & F.col("licence").isin(*licences))
    return top_by(photo_clean(usable), slot, [F.col("votes").desc(), F.col("photo_id")])


def photo_top(photos: DataFrame) -> DataFrame:
    """All published slots: three curated, one per month, one female.

    ``photos`` has taxon_id, photo_id, url, licence, attribution, is_curated,
    position, quality_grade, votes, month, is_female.
    """
    cols = ["taxon_id", "slot", "photo_id", "url", "licence", "attribution"]
    taken = photos.where(~F.col("is_curated"))
    main = (curated(photos.where("is_curated"))
            .withColumn("slot", F.concat(F.lit("main_"), F.col("rank").cast("string"))))
    monthly = (best_voted(taken.where(F.col("month").between(1, 12)), ["taxon_id", "month"])
               .withColumn("slot", F.format_string("month_%02d", "month")))
    female = (best_voted(taken.where("is_female"), ["taxon_id"])
              .withColumn("slot", F.lit("female")))
    return (main.select(*cols).unionByName(monthly.select(*cols)).unionByName(female.select(*cols)))


def photo_coverage(top: DataFrame) -> DataFrame:
    """Per taxon: curated count, months filled of twelve, female present."""
    return top.groupBy("taxon_id").agg(
        F.count_if(F.col("slot").startswith("main_")).alias("n_main"),
        F.count_if(F.col("slot").startswith("month_")).alias("n_months"),
        (F.count_if(F.col("slot") == "female") > 0).alias("has_female"))


def photo_documents(top: DataFrame) -> DataFrame:
    """One nested record per taxon: main list, month map, female photo."""
    photo = F.struct("url", "licence", "attribution")
    slot = F.col("slot")
    return top.groupBy("taxon_id").agg(
        F.transform(F.sort_array(F.collect_list(
            F.when(slot.startswith("main_"), F.struct(slot.alias("s"), photo.alias("p"))))),
            lambda x: x["p"]).alias("main"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.when(slot.startswith("month_"),
                   F.struct(F.substring(slot, 7, 2).alias("k"), photo.alias("v")))))).alias("months"),
        F.first(F.when(slot == "female", photo), ignorenulls=True).alias("female"))
