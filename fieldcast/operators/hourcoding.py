"""Two ways to code the hour of day, compared in unpenalised fits.

The fits use the solver of the ridge models without a penalty. At the optimum one
more pass sums the Fisher information, the weighted cross products of all
columns; its inverse gives standard errors, and the log-likelihood of the same
pass gives AIC and McFadden's pseudo R-squared. Spline knots are kept as a
published basis, so a later outing's terms are a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import sigmoid
from fieldcast.functions.splines import (DEGREE, basis_table, basis_values, bspline,
                                         inner_probabilities)
from fieldcast.operators import solver
from fieldcast.operators.labels import hour_support
from fieldcast.operators.ranks import quantiles
from fieldcast.session import stored

REFERENCE = 8
#: degrees of freedom of the splines
DOY_DF, HOUR_DF = 3, 4
#: outings of one stored block
BLOCK_ROWS = 4096
# The published example's hours and outing.
EXAMPLE_HOURS = (6, 7, 8, 10, 12, 14, 19)
# a one-hour, one-kilometre walk in mid-May, wind 12, 18 degrees, dry
EXAMPLE = {"log_dur": math.log(1.0), "log_dist": math.log1p(1.0), "doy": 134,
           "wind_max": 12.0, "temp_mean": 18.0, "precip_sum": 0.0}
WEATHER = ("wind_max", "temp_mean", "precip_sum")


def supported_hours(table: DataFrame, lo: int | None = None, hi: int | None = None,
                    min_per_hour: int = P.MIN_PER_HOUR) -> tuple[DataFrame, DataFrame]:
    """Rows in range whose hour has enough of them, and the hour counts.

    Thin hours separate perfectly in an unpenalised fit and must go first.
    """
    if lo is not None:
        table = table.where(F.col("hr").between(lo, hi))
    counts = hour_support(table, min_per_hour).where("supported").select("hr", "n")
    return table.join(counts.select("hr"), "hr", "left_semi"), counts


def spline_knots(table: DataFrame, column: str, df: int) -> list[float]:
    """The whole knot list for ``column``: its ends, and inner knots at quantiles."""
    probs = inner_probabilities(df)
    ends = table.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    parts = len(probs) + 1
    inner = [] if not probs else [
        r["value"] for r in quantiles(table.select(F.col(column).cast("double").alias("x")),
                                      [], "x", parts)
        .where(F.col("k").between(1, parts - 1)).orderBy("k").collect()]
    return [float(ends[0])] * (DEGREE + 1) + inner + [float(ends[1])] * (DEGREE + 1)


def spline_columns(knots: Sequence[float], column: str) -> dict[str, Column]:
    """Basis of ``column`` on a knot list, by term name."""
    inner = knots[DEGREE + 1:-DEGREE - 1]
    basis = bspline(F.col(column).cast("double"), knots[0], knots[-1], inner)
    return {f"{column}_{i + 1}": c for i, c in enumerate(basis)}


def base_columns(doy_knots: Sequence[float]) -> dict[str, Column]:
    return {"log_dur": F.col("log_dur"), "log_dist": F.col("log_dist"),
            **spline_columns(doy_knots, "doy"), **{c: F.col(c) for c in WEATHER}}


def dummy_columns(hours: Sequence[int], reference: int = REFERENCE) -> dict[str, Column]:
    return {f"hr_{h:02d}": (F.col("hr") == h).cast("double") for h in hours if h != reference}


@dataclass(frozen=True)
class Fit:
    """An unpenalised fit: coefficients and standard errors by term."""

    beta: dict[str, float]
    errors: dict[str, float]
    n: int
    positives: int
    log_likelihood: float

    @property
    def aic(self) -> float:
        return 2.0 * len(self.beta) - 2.0 * self.log_likelihood

    @property
    def pseudo_r2(self) -> float:
        """McFadden's: one minus the ratio to the fit of an intercept alone."""
        null = sum(k * math.log(k / self.n) for k in (self.positives, self.n - self.positives))
        return 1.0 - self.log_likelihood / null

    def p_value(self, term: str) -> float:
        """Two-sided, of the normal distribution."""
        return math.erfc(abs(self.beta[term] / self.errors[term]) / math.sqrt(2.0))

    def total(self, columns: dict[str, Column]) -> Column:
        """The linear predictor of rows that have the columns."""
        out = F.lit(self.beta["intercept"])
        for k, c in columns.items():
            out = out + c.cast("double") * F.lit(self.beta[k])
        return out


def fit_unpenalised(table: DataFrame, species: str, columns: dict[str, Column]) -> Fit | None:
    """Unpenalised logistic fit with standard errors; none if one class is missing."""
    seen = F.coalesce(F.array_contains("seen", species), F.lit(False))
    n, positives = table.agg(F.count(F.lit(1)), F.count_if(seen)).first()
    if not 0 < positives < n:
        return None
    values = F.array(*[c.cast("double") for c in columns.values()])
    rows = table.select(F.struct(values.alias("num"), F.when(seen, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>")).alias("seen")).alias("row"))
    slice_ = F.pmod(F.xxhash64("row.num"), F.lit(math.ceil(n / BLOCK_ROWS)))
    blocks = stored(rows.groupBy(slice_.alias("slice")).agg(F.collect_list("row").alias("rows")).select(
        F.lit(-1).alias("hot"), F.lit(False).alias("own"), "rows"), "blocks")
    layout = solver.Layout((), len(columns), 0, 0.0)
    theta = solver.solve(blocks, layout, [0], 1, [positives / n])[0]
    loss, information = solver.information(blocks, layout, theta)
    errors = np.sqrt(np.diag(np.linalg.pinv(information, hermitian=True)))
    names = ["intercept", *columns]
    return Fit(dict(zip(names, theta.tolist())), dict(zip(names, errors.tolist())), n, positives, -loss)


def _inputs(table: DataFrame, lo: int | None, hi: int | None, min_per_hour: int):
    rows, counts = supported_hours(table, lo, hi, min_per_hour)
    rows = stored(rows.select("seen", "hr", "hour", "doy", "log_dur", "log_dist", *WEATHER), "hours")
    hours = sorted(r["hr"] for r in counts.collect())  # at most 25
    return rows, counts, hours


def _main_fit(table: DataFrame, species: str, min_per_hour: int):
    """Rows of the daytime hours, their counts, and the dummy-coded fit with its columns."""
    rows, counts, hours = _inputs(table, 5, 20, min_per_hour)
    columns = {**base_columns(spline_knots(rows, "doy", DOY_DF)), **dummy_columns(hours)} if hours else {}
    return rows, counts, hours, columns, fit_unpenalised(rows, species, columns) if hours else None


def hour_coding(table: DataFrame, species: str, min_per_hour: int = P.MIN_PER_HOUR) -> DataFrame:
    """Parameters, AIC and pseudo R-squared of both codings."""
    rows, _, hours, columns, dummy = _main_fit(table, species, min_per_hour)
    out = []
    if dummy:
        base = {k: c for k, c in columns.items() if not k.startswith("hr_")}
        spline = {**base, **spline_columns(spline_knots(rows, "hour", HOUR_DF), "hour")}
        for name, fit in (("spline", fit_unpenalised(rows, species, spline)), ("dummy", dummy)):
            out.append((name, fit.n, len(fit.beta) - 1, fit.aic, fit.pseudo_r2))
    return table.sparkSession.createDataFrame(
        out, "coding string, n bigint, params int, aic double, pseudo_r2 double")


def odds_ratios(table: DataFrame, species: str, min_per_hour: int = P.MIN_PER_HOUR) -> DataFrame:
    """Odds ratio of each hour against the reference, its p-value and n."""
    _, counts, hours, columns, fit = _main_fit(table, species, min_per_hour)
    found = []
    for h in hours if fit else []:
        if h == REFERENCE:
            found.append((h, 1.0, None, False))
        else:
            p = fit.p_value(f"hr_{h:02d}")
            found.append((h, math.exp(fit.beta[f"hr_{h:02d}"]), p, p < 0.05))
    terms = table.sparkSession.createDataFrame(
        found, "hr int, odds_ratio double, p_value double, significant boolean")
    return terms.join(counts, "hr", "inner")


def hour_balance(table: DataFrame, species: str, min_per_hour: int = P.MIN_PER_HOUR) -> DataFrame:
    """Fitted detections per hour of the dummy-coded fit.

    Without a penalty these equal the detections of every hour that has its own
    column, and of the reference hour through the intercept.
    """
    rows, _, hours, columns, fit = _main_fit(table, species, min_per_hour)
    if not fit:
        return rows.limit(0).select("hr", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("fitted"))
    return (rows.select("hr", sigmoid(fit.total(columns)).alias("p")).groupBy("hr")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("fitted")))


def hour_contrasts(table: DataFrame, species: str, min_per_hour: int = P.MIN_PER_HOUR
                   ) -> DataFrame:
    """Hours against the reference with no other predictor in the fit.

    Odds ratio and standard error then follow from each hour's 2 x 2 counts.
    Columns: hr, odds_ratio, std_error, aic (of the whole fit).
    """
    rows, _, hours = _inputs(table, 5, 20, min_per_hour)
    columns = dummy_columns(hours) if REFERENCE in hours else {}
    fit = fit_unpenalised(rows, species, columns) if columns else None
    return table.sparkSession.createDataFrame(
        [(int(k[3:]), math.exp(fit.beta[k]), fit.errors[k], fit.aic) for k in columns] if fit else [],
        "hr int, odds_ratio double, std_error double, aic double")


def example_model(table: DataFrame, species: str, min_per_hour: int = P.MIN_PER_HOUR
                  ) -> tuple[DataFrame, DataFrame, list[int]]:
    """What a published example needs: coefficients by term, the spline's basis as
    rows, and the hours with a term or the reference."""
    spark = table.sparkSession
    rows, _, hours = _inputs(table, None, None, min_per_hour)
    knots = {"doy": spline_knots(rows, "doy", DOY_DF)} if hours else {}
    columns = {**base_columns(knots["doy"]), **dummy_columns(hours)} if hours else {}
    fit = fit_unpenalised(rows, species, columns) if hours else None
    coefs = spark.createDataFrame(list(fit.beta.items()) if fit else [], "term string, value double")
    return coefs, basis_table(spark, knots), hours if fit else []


def worked_example(table: DataFrame, species: str, hours: Sequence[int] = EXAMPLE_HOURS,
                   min_per_hour: int = P.MIN_PER_HOUR, outing: dict[str, float] | None = None
                   ) -> DataFrame:
    """A fixed outing at several hours: hour term, total and probability.

    The outing's terms are its plain values, its hour, and the published basis at
    its day; a day outside the fitted range has no basis there and counts as the
    nearest end. All of them join the coefficients by name.
    """
    spark = table.sparkSession
    outing = EXAMPLE if outing is None else outing
    coefs, basis, fitted = example_model(table, species, min_per_hour)
    spine = spark.createDataFrame([(h, "doy", float(outing["doy"])) for h in hours if h in fitted],
                                  "hr int, variable string, x double")
    one = F.lit(1.0).alias("value")
    plain = F.inline(F.array(*[F.struct(F.lit(k).alias("term"), F.lit(float(v)).alias("value"))
                               for k, v in outing.items() if k != "doy"],
                             F.struct(F.lit("intercept").alias("term"), one)))
    terms = (spine.select("hr", plain)
             .unionByName(spine.select("hr", F.format_string("hr_%02d", "hr").alias("term"), one))
             .unionByName(basis_values(spine, basis).select("hr", "term", "value")))
    part = F.col("value") * F.col("beta")
    total = F.sum(part)
    return (terms.join(coefs.withColumnRenamed("value", "beta"), "term").groupBy("hr").agg(
        F.coalesce(F.sum(F.when(F.col("term").startswith("hr_"), part)), F.lit(0.0)).alias("hour_term"),
        total.alias("total"), sigmoid(total).alias("probability"))
        .withColumn("is_reference", F.col("hr") == REFERENCE))


def spline_values(table: DataFrame, min_per_hour: int = P.MIN_PER_HOUR) -> DataFrame:
    """The published basis at every day and hour of the fitted rows: variable, x,
    term, value."""
    rows, _, hours = _inputs(table, 5, 20, min_per_hour)
    knots = {"doy": spline_knots(rows, "doy", DOY_DF), "hour": spline_knots(rows, "hour", HOUR_DF)} \
        if hours else {}
    points = [rows.select(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")).distinct()
              for v in ("doy", "hour")]
    return basis_values(points[0].unionByName(points[1]), basis_table(table.sparkSession, knots))
