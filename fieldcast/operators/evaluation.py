"""Grouped hold-outs and honest-probability metrics, per group of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import logit_bucket
from fieldcast.operators.ranks import quantile_bins, ranked_counts, running_totals, value_counts


def group_holdout(df: DataFrame, group: str, share: float = P.TEST_SHARE,
                  seed: int = P.SEED) -> DataFrame:
    """Whole groups held out: ``ceil(share * groups)`` of them, by seeded hash.

    Ranks groups by a digest of (group, seed). The rank is a running total over
    digest-prefix buckets, so no task sorts all groups.
    """
    digest = F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{seed}")))
    groups = (df.select(group).where(F.col(group).isNotNull()).distinct()
              .withColumn("digest", digest).withColumn("one", F.lit(1)))
    bucket = F.conv(F.substring("digest", 1, 3), 16, 10).cast("long")
    ranked = running_totals(groups, [], "digest", bucket, {"one": "rank"})
    return ranked.select(group, (F.col("rank") <= F.ceil(F.col("rank_all") * F.lit(share)))
                         .alias("is_test"))


def score_counts(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distinct scores per group with counts of rows and of positives."""
    return value_counts(scored, group, "p", {"pos": F.sum(F.col("y").cast("long"))})


def _ranked(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    return ranked_counts(counts, group, "p", logit_bucket(F.col("p")), {"pos": "cum_pos"})


def roc_auc() -> Column:
    """Mid-rank area under the ROC curve, as an aggregate over ranked counts."""
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    below = F.col("cum").cast("double") - F.col("cum_pos") - (n - pos)
    wins = F.sum(pos * (below + (n - pos) / F.lit(2.0)))
    all_pos = F.max("cum_pos_all").cast("double")
    return F.try_divide(wins, all_pos * (F.max("cum_all").cast("double") - all_pos))


def average_precision() -> Column:
    """Step-wise sum of precision over recall gains, tied scores together."""
    at_or_above = F.col("cum_all") - F.col("cum") + F.col("n")
    hits = F.col("cum_pos_all") - F.col("cum_pos") + F.col("pos")
    gain = F.try_divide(F.col("pos").cast("double"), F.col("cum_pos_all"))
    return F.sum(gain * (hits.cast("double") / at_or_above))


def brier() -> Column:
    """Mean squared error of the probabilities, from score counts."""
    p, n, pos = F.col("p"), F.col("n"), F.col("pos")
    err = pos * (F.lit(1.0) - p) * (F.lit(1.0) - p) + (n - pos) * p * p
    return F.sum(err) / F.sum("n")


def _calibration(ranked: DataFrame, group: Sequence[str], bins: int) -> DataFrame:
    n = F.sum("n")
    return (quantile_bins(ranked, group, "p", bins).where(F.col("bin").isNotNull())
            .groupBy(*group, "bin")
            .agg((F.sum(F.col("p") * F.col("n")) / n).alias("pred"),
                 (F.sum("pos") / n).alias("obs"), n.alias("n"))
            .withColumn("gap", F.col("obs") - F.col("pred")))


def calibration_table(scored: DataFrame, group: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean predicted and observed rate per quantile bin of the score."""
    return _calibration(_ranked(score_counts(scored, group), group), group, bins)


def calibration_mae(table: DataFrame, group: Sequence[str], good: float = P.CAL_GOOD,
                    bad: float = P.CAL_BAD) -> DataFrame:
    """Unweighted mean absolute gap over bins, with a verdict."""
    return (table.groupBy(*group).agg(F.avg(F.abs("gap")).alias("cal_mae"))
            .withColumn("verdict", F.when(F.col("cal_mae") < good, "good")
                        .when(F.col("cal_mae") > bad, "bad").otherwise("fair")))


def eval_metrics(scored: DataFrame, group: Sequence[str], bins: int = 10) -> DataFrame:
    """Brier score, AUC, average precision and calibration error per group.

    All are null where the test rows hold one class only: there is nothing to
    evaluate. Scores enter as counts per distinct value, ranked once.
    """
    return count_metrics(score_counts(scored, group), group, bins)


def count_metrics(counts: DataFrame, group: Sequence[str], bins: int = 10) -> DataFrame:
    """``eval_metrics`` from score counts alone: all that they need of the rows."""
    group = list(group)
    ranked = _ranked(counts, group)
    base = ranked.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), brier().alias("brier"),
        roc_auc().alias("auc"), average_precision().alias("avg_precision"))
    mae = calibration_mae(_calibration(ranked, group, bins), group).drop("verdict")
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    out = base.join(mae, group, "left")
    for c in ("brier", "auc", "avg_precision", "cal_mae"):
        out = out.withColumn(c, F.when(both, F.col(c)))
    return out


def eval_summary(metrics: DataFrame, split: str = "split") -> DataFrame:
    """Mean and median over species, per split; nulls are left out.

    One row per species goes in, so the exact percentile buffer is small.
    """
    return metrics.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_species"),
        F.avg("cal_mae").alias("mean_cal_mae"),
        F.percentile("cal_mae", 0.5).alias("median_cal_mae"),
        F.avg("auc").alias("mean_auc"),
        F.percentile("auc", 0.5).alias("median_auc"),
        F.avg("brier").alias("mean_brier"))
