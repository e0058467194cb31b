"""Cubic B-spline basis: as column expressions, and published as rows."""

from __future__ import annotations

from collections.abc import Sequence

from numpy.polynomial import Polynomial
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEGREE = 3


def inner_probabilities(df: int) -> list[float]:
    """Quantiles at which inner knots sit: ``df - degree`` of them, evenly."""
    n = df - DEGREE
    if n < 0:
        raise ValueError(f"df must be at least {DEGREE}")
    return [(i + 1) / (n + 1) for i in range(n)]


def bspline(x: Column, lo: float, hi: float, inner: Sequence[float] = ()) -> list[Column]:
    """Basis columns on [lo, hi], without the first one (that is the intercept's).

    Standard recursion over the knot list with repeated ends. The last
    interval is closed, so the upper end belongs to the last function.
    """
    knots = [lo] * (DEGREE + 1) + list(inner) + [hi] * (DEGREE + 1)
    last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1])
    zero = F.lit(0.0)

    def indicator(i: int) -> Column | None:
        if knots[i] >= knots[i + 1]:
            return None
        upper = (x <= knots[i + 1]) if i == last else (x < knots[i + 1])
        return F.when((x >= knots[i]) & upper, F.lit(1.0)).otherwise(zero)

    level: list[Column | None] = [indicator(i) for i in range(len(knots) - 1)]
    for d in range(1, DEGREE + 1):
        nxt: list[Column | None] = []
        for i in range(len(level) - 1):
            parts = []
            if level[i] is not None:
                parts.append((x - F.lit(knots[i])) / F.lit(knots[i + d] - knots[i]) * level[i])
            if level[i + 1] is not None:
                width = knots[i + d + 1] - knots[i + 1]
                parts.append((F.lit(knots[i + d + 1]) - x) / F.lit(width) * level[i + 1])
            nxt.append(parts[0] + parts[1] if len(parts) == 2 else parts[0] if parts else None)
        level = nxt
    return [c if c is not None else zero for c in level[1:]]


BASIS = ("variable string, fn int, lo double, hi double, last boolean, "
         "c0 double, c1 double, c2 double, c3 double")


def pieces(knots: Sequence[float]) -> list[tuple[int, float, float, bool, list[float]]]:
    """(number, lo, hi, whether this is the last interval, coefficients) of every
    basis function on every interval of the whole knot list where it is not zero.

    The polynomials run in the place inside the interval, 0 at ``lo`` and 1 at
    ``hi``. The first function is the intercept's and left out.
    """
    inside = [i for i in range(len(knots) - 1) if knots[i] < knots[i + 1]]
    out = []
    for i in inside:
        lo, hi = knots[i], knots[i + 1]
        x = Polynomial([lo, hi - lo])
        level = {i: Polynomial([1.0])}  # functions that are not zero here
        for d in range(1, DEGREE + 1):
            level = _raised(level, knots, x, i, d)
        for j, p in level.items():
            c = [*p.coef.tolist(), 0.0, 0.0, 0.0, 0.0][:DEGREE + 1]
            if j and any(c):
                out.append((j, float(lo), float(hi), i == inside[-1], c))
    return out


def _raised(level: dict[int, Polynomial], knots: Sequence[float], x: Polynomial, i: int, d: int
            ) -> dict[int, Polynomial]:
    """The functions of degree ``d`` on interval ``i`` from those one degree lower."""
    out = {}
    for j in range(i - d, i + 1):
        p = Polynomial([0.0])
        if j in level and knots[j + d] > knots[j]:
            p = p + (x - knots[j]) / (knots[j + d] - knots[j]) * level[j]
        if j + 1 in level and knots[j + d + 1] > knots[j + 1]:
            p = p + (knots[j + d + 1] - x) / (knots[j + d + 1] - knots[j + 1]) * level[j + 1]
        out[j] = p
    return out


def basis_table(spark: SparkSession, knots: dict[str, Sequence[float]]) -> DataFrame:
    """The pieces of each variable's basis as rows, to be kept with its coefficients."""
    rows = [(name, fn, lo, hi, last, *c) for name, all_ in knots.items()
            for fn, lo, hi, last, c in pieces(all_)]
    return spark.createDataFrame(rows, BASIS)


def basis_values(points: DataFrame, basis: DataFrame) -> DataFrame:
    """``points`` (variable, x, and more) with the value of each function, as
    ``term`` and ``value``. A point outside the range counts as its nearest end."""
    ends = basis.groupBy("variable").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    at = points.join(ends, "variable").withColumn("_x", F.least("_hi", F.greatest("_lo", "x")))
    u = (F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    value = F.col("c0") + u * (F.col("c1") + u * (F.col("c2") + u * F.col("c3")))
    met = at.join(basis, "variable").where(
        (F.col("_x") >= F.col("lo")) & ((F.col("_x") < F.col("hi")) | F.col("last")))
    return met.select(*points.columns, F.concat("variable", F.lit("_"), F.col("fn").cast("string"))
                      .alias("term"), value.alias("value"))
