"""Exact running totals, quantiles and quantile bins without one big task.

A window over one group sorts that group in one task, and the built-in exact
percentile keeps every distinct value of a group in one buffer. Both break when
a group holds a third of all rows. Here a group is first reduced to its
distinct values with counts, then cut into value buckets. Bucket totals give
each bucket its offset, and the sort runs per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_bucket(x: Column) -> Column:
    """A coarse bucket that never decreases as ``x`` grows, at any scale.

    Signed log with steps of a thousandth of a natural log unit.
    """
    tiny, step = F.lit(1e-12), F.lit(1000.0)
    mag = F.floor((F.ln(F.greatest(F.abs(x), tiny)) - F.ln(tiny)) * step).cast("long")
    return F.when(x > 0, mag).when(x < 0, -mag).otherwise(F.lit(0).cast("long"))


def running_totals(df: DataFrame, group: Sequence[str], order: str, bucket: Column,
                   sums: dict[str, str]) -> DataFrame:
    """Cumulative sums over ``order`` within ``group``, plus group totals.

    ``order`` must be unique within a group and ``bucket`` must not decrease
    as ``order`` grows. For each ``{column: name}`` in ``sums`` this adds
    ``name`` (inclusive running sum) and ``name_all`` (group total).
    """
    df = df.withColumn("_b", bucket)
    group = list(group)
    per = df.groupBy(*group, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for c, n in sums.items()])
    # at most a few tens of thousands of buckets per group
    prev = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offs = per.select(
        *group, "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(prev), F.lit(0)).alias(f"_o_{n}")
          for n in sums.values()],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in sums.values()])
    inside = (Window.partitionBy(*group, "_b").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for c, n in sums.items()])
    out = out.join(offs, [*group, "_b"], "inner")
    for n in sums.values():
        out = out.withColumn(n, F.col(f"_i_{n}") + F.col(f"_o_{n}"))
    return out.drop("_b", *[f"_i_{n}" for n in sums.values()], *[f"_o_{n}" for n in sums.values()])


def value_counts(df: DataFrame, group: Sequence[str], value: str,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values per group with counts; equal values combine map-side."""
    extra = extra or {}
    return df.groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()])


def quantiles_of_counts(ranked: DataFrame, group: Sequence[str], value: str, parts: int) -> DataFrame:
    """Linear-interpolated quantiles ``k/parts`` from ranked value counts.

    ``ranked`` carries ``n``, its running sum ``cum`` and total ``cum_all``.
    Positions use whole-number arithmetic, so an edge that falls on an order
    statistic equals it exactly.
    """
    pos = (F.col("cum_all") - 1) * F.col("k")
    lo = F.expr("(cum_all - 1) * k div {}".format(parts))
    frac = pos % parts
    ks = ranked.select(*group, F.col(value).alias("_x"), "n", "cum", "cum_all",
                       F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("k"))
    first = F.col("cum") - F.col("n")
    holds_lo = (lo >= first) & (lo < F.col("cum"))
    holds_hi = (lo + 1 >= first) & (lo + 1 < F.col("cum"))
    picked = (ks.where(holds_lo | holds_hi)
              .groupBy(*group, "k")
              .agg(F.max(F.when(holds_lo, F.col("_x"))).alias("_lo"),
                   F.max(F.when(holds_hi, F.col("_x"))).alias("_hi"),
                   F.max(frac).alias("_f")))
    w = F.col("_f") / F.lit(float(parts))
    value_at = F.when(F.col("_f") == 0, F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * w)
    return picked.select(*group, "k", value_at.alias("value"))


def ranked_counts(counts: DataFrame, group: Sequence[str], value: str,
                  bucket: Column | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    return running_totals(counts, group, value,
                          value_bucket(F.col(value)) if bucket is None else bucket,
                          {"n": "cum", **(sums or {})})


def quantiles(df: DataFrame, group: Sequence[str], value: str, parts: int) -> DataFrame:
    counts = value_counts(df, group, value)
    return quantiles_of_counts(ranked_counts(counts, group, value), group, value, parts)


def quantile_bins(ranked: DataFrame, group: Sequence[str], value: str, parts: int) -> DataFrame:
    """Quantile bin of each distinct value: right-closed, lowest included,
    repeated edges merged. A single remaining edge gives no bin (null)."""
    edges = (quantiles_of_counts(ranked, group, value, parts)
             .groupBy(*group).agg(F.sort_array(F.collect_set("value")).alias("_edges")))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return (ranked.join(edges, list(group), "inner")
            .withColumn("bin", F.when(F.size("_edges") > 1, F.greatest(below, F.lit(1)) - 1))
            .drop("_edges"))
