"""The score grid kept up to date as forecast snapshots follow each other.

A new snapshot changes the weather of some slots, adds days at one end and drops
them at the other. Only slots that changed are scored; the rest of their (area,
day) is carried over. The store is append-only: version ``v`` writes the rows of
the (area, day) pairs it touched, and an index that says for every live pair which
version holds it. A version that fails leaves the one before whole and can be
written again under a new number; readers follow one index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.operators.scoring import WEATHER, Outing, score_grid
from fieldcast.session import scratch_path, stored


def changes(before: DataFrame | None, after: DataFrame, area: Sequence[str]) -> DataFrame:
    """area, day, hour and ``state`` of every slot of two snapshots of weather over
    outings' hours: new, changed, same or gone. Values are compared with nulls
    equal, so a slot whose weather stays unknown is the same."""
    keys = [*area, "day", "hour"]
    packed = F.struct("n_hours", *WEATHER)
    new = after.select(*keys, packed.alias("b"))
    if before is None:
        return new.select(*keys, F.lit("new").alias("state"))
    old = before.select(*keys, packed.alias("a"))
    state = (F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone")
             .when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed"))
    return old.join(new, keys, "full").select(*keys, state.alias("state"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def _semi(df: DataFrame, keys_of: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    other = keys_of.select(*keys).distinct()
    return df.join(other, _same(df, other, keys), how)


def current(spark: SparkSession, root: str, version: int, area: Sequence[str]) -> DataFrame:
    """The grid as of a version: each (area, day) from the version that wrote it."""
    index = spark.read.parquet(f"{root}/index/version={version}")
    # the versions in use; one per day of the window and a few more
    used = [r["held"] for r in index.select("held").distinct().collect()]
    rows = spark.read.parquet(f"{root}/grid").where(F.col("version").isin(used))
    return rows.join(index, _same(rows, index, [*area, "day"]) & (rows["version"] == index["held"]),
                     "left_semi").drop("version")


def roll(root: str, version: int, coefs: DataFrame, before: DataFrame | None, after: DataFrame,
         sites: DataFrame, area: Sequence[str], outing: Outing = Outing(),
         min_support: float = P.MIN_PER_HOUR) -> DataFrame:
    """Write version ``version`` of the grid and say what it took.

    ``before`` is the snapshot of the version before, none for the first one or
    after a refit; ``after`` the new one. Gives area, day, n_slots and n_scored of
    every live (area, day).
    """
    spark = coefs.sparkSession
    sites = sites.where("loc_id is not null")
    pair, slot = [*area, "day"], [*area, "day", "hour"]
    diff = stored(changes(before, after, area), "slot-changes")
    moved = F.col("state").isin("new", "changed")
    live = diff.where("state <> 'gone'").groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_slots"), F.count_if(moved).alias("n_scored"))
    # a pair is written anew if any of its slots came, went or changed
    touched = stored(diff.where("state <> 'same'").select(*pair).distinct()
                     .join(live.select(*pair), pair, "left_semi"), "touched")
    fresh = after.join(diff.where(moved).select(*slot), slot, "left_semi")
    near = sites.join(fresh.select(*area).distinct(), list(area), "left_semi")
    rows = score_grid(coefs, fresh, near, area, outing, min_support, keep=area)
    # an area without any forecast keeps a row per species and site that says so
    bare = sites.join(after.select(*area).distinct(), list(area), "left_anti")
    if before is not None:
        old = current(spark, root, version - 1, area)
        same = diff.where("state = 'same'").select(*slot).join(touched, pair, "left_semi")
        rows = rows.unionByName(old.join(same, slot, "left_semi"))
        bare = bare.join(before.select(*area).distinct(), list(area), "left_semi")
    lacking = score_grid(coefs, after.limit(0), bare, area, outing, min_support, keep=area)
    # as the tasks make them: a reader takes whole versions, and a day of an area may be large
    rows.unionByName(lacking).write.parquet(f"{root}/grid/version={version}")
    held = F.lit(version).alias("held")
    index = touched.select(*pair, held).unionByName(
        bare.select(*area, F.lit(None).cast("date").alias("day"), held).distinct())
    if before is not None:
        last = spark.read.parquet(f"{root}/index/version={version - 1}")
        still = live.select(*pair).unionByName(
            sites.join(after.select(*area).distinct(), list(area), "left_anti")
            .select(*area, F.lit(None).cast("date").alias("day")).distinct())
        index = index.unionByName(_semi(_semi(last, still, pair), index, pair, "left_anti"))
    index.write.parquet(f"{root}/index/version={version}")
    return live


def recomputed(coefs: DataFrame, after: DataFrame, sites: DataFrame, area: Sequence[str],
               outing: Outing = Outing()) -> DataFrame:
    """What the store should hold: the whole grid of one snapshot."""
    return score_grid(coefs, after, sites.where("loc_id is not null"), area, outing, keep=area)


def new_store(spark: SparkSession) -> str:
    return scratch_path(spark, "rolling")
