"""Rounding and link functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snap(x: Column, step: float) -> Column:
    """Nearest multiple of ``step``, ties to even."""
    return F.rint(x / F.lit(step)) * F.lit(step)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def round_half_up_int(x: Column) -> Column:
    """Round with ties upward, so -2.5 becomes -2."""
    return F.floor(x + F.lit(0.5)).cast("int")


def logit_bucket(p: Column, per_unit: int = 1024) -> Column:
    """Coarse bucket that never decreases as ``p`` grows.

    Subtraction, division and log are monotone in double arithmetic, so equal
    scores share a bucket and a lower score never lands in a higher one. The
    log-odds scale spreads out scores packed near 0 or 1.
    """
    low, high = F.lit(-1_000_000_000).cast("long"), F.lit(1_000_000_000).cast("long")
    safe = F.when((p > 0) & (p < 1), p)
    mid = F.floor(F.ln(safe / (F.lit(1.0) - safe)) * F.lit(float(per_unit))).cast("long")
    return F.when(p <= 0, low).when(p >= 1, high).otherwise(mid)
