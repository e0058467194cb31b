"""Ridge logistic models of all species, fitted together.

All species share one stored table of outings, packed by site, and every pass of
the solver (``operators/solver.py``) reads it once for all of them. The label of
a species is a membership test on the outing's set of seen species, so no frame
of outings x species exists.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import sigmoid
from fieldcast.operators import solver
from fieldcast.operators.coefficients import term_block
from fieldcast.operators.dedup import salted_join
from fieldcast.operators.evaluation import count_metrics, group_holdout, score_counts
from fieldcast.operators.labels import species_array
from fieldcast.operators.scoring import spread, with_terms
from fieldcast.session import scratch_path, stored


@dataclass(frozen=True)
class Design:
    """Which columns enter a model and how."""

    categorical: Sequence[str] = P.CATEGORICAL
    numeric: Sequence[str] = P.NUMERIC
    drop_first: bool = False
    c: float = P.RIDGE_C


TERMS = "species_code string, term string, value double"

# The variant used to check calibration: no site effect, coordinates instead,
# and the first level of each category as the baseline.
CALIBRATION_DESIGN = Design(("hr", "week"), (*P.NUMERIC, "lat", "lon"), drop_first=True)

#: outings of one block, and of a site that still is one block, at most
BLOCK_ROWS, SITE_ROWS = 4096, 1 << 16


@dataclass
class Prepared:
    """A fitted encoding: levels of the calendar columns, scales of the numeric
    ones, and the sites of several blocks with their number of blocks."""

    design: Design
    n: int
    levels: dict[str, list[str]]
    mean: dict[str, float]
    scale: dict[str, float]
    hot: dict[str, int]

    @property
    def layout(self) -> solver.Layout:
        return solver.Layout(tuple(map(len, self.levels.values())), len(self.mean), len(self.hot),
                             1.0 / self.design.c)

    @property
    def terms(self) -> list[str]:
        """What stands in a coefficient vector behind the intercept."""
        return [*(_term(c, x) for c, levels in self.levels.items() for x in levels),
                *self.design.numeric, *(_term("site", s) for s in self.hot)]


def _level(column: str) -> Column:
    """Category level as text; numbers padded so text order is number order."""
    c = F.col(column)
    return F.format_string("%02d", c) if column in ("hr", "week") else c.cast("string")


def _several_blocks(n: int) -> int:
    """Outings from which on a site is split: more than a task should hold, or, in a
    small table, more than a sixty-fourth of all."""
    return min(SITE_ROWS, max(BLOCK_ROWS, n // 64))


def prepare(train: DataFrame, design: Design = Design()) -> Prepared:
    """Fit the encoding on training rows.

    Unknown levels add nothing at scoring time. Hours and weeks are a calendar's,
    so their levels are few; sites stay in tables, but for those of several blocks,
    of which there are no more than outings over the block limit.
    """
    dense = [c for c in design.categorical if c != "site"]
    stats = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.array_sort(F.collect_set(_level(c))).alias(f"l_{c}") for c in dense],
        *[F.avg(c).alias(f"m_{c}") for c in design.numeric],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in design.numeric]).first()
    n = stats["n"]
    hot = {}
    if "site" in design.categorical:
        counts = train.where(F.col("site").isNotNull()).groupBy("site").agg(F.count(F.lit(1)).alias("c"))
        hot = {r["site"]: math.ceil(r["c"] / BLOCK_ROWS) for r in
               counts.where(F.col("c") > _several_blocks(n)).orderBy("site").collect()}
    # a constant column keeps scale 1
    return Prepared(design, n, {c: stats[f"l_{c}"][1 if design.drop_first else 0:] for c in dense},
                    {c: stats[f"m_{c}"] or 0.0 for c in design.numeric},
                    {c: stats[f"s_{c}"] or 1.0 for c in design.numeric}, hot)


def pack(train: DataFrame, prep: Prepared, species: Sequence[str]) -> DataFrame:
    """site, hot, own, rows: the training rows as blocks, stored.

    A site of one block is whole (``own``); a split site goes by its number in
    ``hot``, rows without a site belong to none. Values are those of the solver:
    numbers of levels, standardised numerics, numbers of the species seen.
    """
    spark = train.sparkSession
    number = lambda names, c: (F.coalesce(F.array_position(
        F.array(*map(F.lit, names)), c), F.lit(0)) - 1 if names else F.lit(-1)).cast("int")
    codes = F.array(*map(F.lit, species)) if species else F.array().cast("array<string>")
    fields = [*[number(levels, _level(c)).alias(c) for c, levels in prep.levels.items()],
              F.array(*[(F.col(c) - F.lit(prep.mean[c])) / F.lit(prep.scale[c])
                        for c in prep.design.numeric]).cast("array<double>").alias("num"),
              F.transform(F.array_intersect("seen", codes),
                          lambda s: (F.array_position(codes, s) - 1).cast("int")).alias("seen")]
    rows = train.select(F.struct(*fields).alias("row"), F.xxhash64("sub_id").alias("spread"),
                        *(["site"] if "site" in prep.design.categorical else
                          [F.lit(None).cast("string").alias("site")]))
    split = spark.createDataFrame([(s, i, b) for i, (s, b) in enumerate(prep.hot.items())],
                                  "site string, hot int, blocks int")
    slices = math.ceil(max(prep.n, 1) / BLOCK_ROWS)
    rows = rows.join(split, "site", "left").withColumn(
        "salt", F.when(F.col("site").isNull(), F.pmod("spread", F.lit(slices)))
        .otherwise(F.pmod("spread", F.coalesce("blocks", F.lit(1)))))
    packed = rows.groupBy("site", "hot", "salt").agg(F.collect_list("row").alias("rows")).select(
        "site", F.coalesce("hot", F.lit(-1)).alias("hot"),
        (F.col("site").isNotNull() & F.col("hot").isNull()).alias("own"), "rows")
    # a pass is as wide as its work, not as the bytes it reads
    width = max(spark.sparkContext.defaultParallelism, prep.n // (16 * BLOCK_ROWS))
    return stored(packed.repartition(width), "packed")


def coefficient_frame(spark, theta, species: Sequence[str], prep: Prepared) -> DataFrame:
    """Raw-unit coefficients as (species_code, term, value), from the solver's rows."""
    vectors = spark.createDataFrame([(s, row.tolist()) for s, row in zip(species, theta)],
                                    "species_code string, beta array<double>")
    terms = spark.createDataFrame(
        [(0, "intercept", 0.0, 1.0)] +
        [(i, t, prep.mean.get(t, 0.0), prep.scale.get(t, 1.0)) for i, t in enumerate(prep.terms, 1)],
        "i int, term string, mean double, scale double")
    long = vectors.select("species_code", F.posexplode("beta").alias("i", "b")).join(terms, "i")
    raw = long.select("species_code", "term", (F.col("b") / F.col("scale")).alias("value"), "mean")
    shift = raw.groupBy("species_code").agg(F.sum(F.col("value") * F.col("mean")).alias("shift"))
    return raw.join(shift, "species_code").select("species_code", "term", F.when(
        F.col("term") == "intercept", F.col("value") - F.col("shift")).otherwise(F.col("value"))
        .alias("value"))


def _term(kind: str, level: str) -> str:
    return {"hr": f"hour_{level}", "week": f"week_{level}", "site": f"site_{level}"}[kind]


def support_terms(species: DataFrame, support: DataFrame) -> DataFrame:
    """The same hour support for every species, as terms."""
    packed = support.where("supported").select(F.collect_list(F.struct(
        F.format_string("support_%02d", "hr").alias("term"),
        F.col("n").cast("double").alias("value")))).scalar()
    return species.select("species_code", F.inline(packed))


def predict(rows: DataFrame, coefs: DataFrame, design: Design = Design(), salts: int | None = None,
            keep: Sequence[str] = ()) -> DataFrame:
    """(species_code, p, y) of every model on every row, from long coefficients.

    ``keep`` names columns of the rows to carry along.

    A level without a term adds nothing, as an unknown level should. Site
    effects of all species come as one map per site, joined at the size of the
    rows, the pooled site salted, since it holds about half of them. The rows x
    species product is an in-stage explode; all other terms come by species. Rows are
    dealt over the cores before it: a table of outings is few bytes, so its scan has few
    tasks.
    """
    rows = spread(rows, ["sub_id"])
    total = F.col("b_intercept")
    for c in design.numeric:
        total = total + F.col(f"b_{c}") * F.col(c)
    if "site" in design.categorical:
        effects = (term_block(coefs, "site", "site", "e").groupBy("site")
                   .agg(F.map_from_entries(F.collect_list(F.struct("species_code", "e")))
                        .alias("site_effects")))
        rows = salted_join(rows, effects, ["site"], "left", F.col("sub_id"),
                           F.col("site") == P.POOLED_SITE, salts)
        total = total + F.coalesce(F.try_element_at("site_effects", F.col("species_code")),
                                   F.lit(0.0))
    extra = [c for c in design.numeric if c not in P.NUMERIC]
    long = with_terms(rows.withColumn("species_code", F.explode(species_array(coefs)))
                      .withColumn("hour", F.col("hr")), coefs, "inner", extra)
    total = total + F.coalesce("hour_term", F.lit(0.0)) + F.coalesce("week_term", F.lit(0.0))
    return long.select("species_code", *keep, sigmoid(total).alias("p"),
                       F.array_contains("seen", F.col("species_code")).cast("int").alias("y"))


def holdout_split(table: DataFrame, group: str, share: float = P.TEST_SHARE,
                  seed: int = P.SEED) -> DataFrame:
    """The table with ``is_test``, whole groups held out; stored, as a fit reads it often."""
    return stored(table.join(group_holdout(table, group, share, seed), group, "inner"), "split")


def holdout_scores(table: DataFrame, species: Sequence[str], group: str,
                   design: Design = Design(), share: float = P.TEST_SHARE, seed: int = P.SEED) -> DataFrame:
    """Out-of-sample (species_code, p, y): whole groups held out."""
    split = holdout_split(table, group, share, seed)
    coefs = fit_coefficients(split.where(~F.col("is_test")), species, design)
    return predict(split.where("is_test"), coefs, design)


def fit_coefficients(table: DataFrame, species: Sequence[str], design: Design = Design()
                     ) -> DataFrame:
    """Fit every species on the table; long coefficients without support.

    A pass of the solver serves all species, up to ``solver.SPECIES`` together; the
    terms of one such group are written before the next is fitted. A species seen
    on all outings or on none has no finite fit: its coefficients are zero and its
    intercept is infinite.
    """
    spark = table.sparkSession
    prep = prepare(table, design)
    packed = pack(table, prep, species)
    seen = {r["k"]: r["n"] for r in packed.select(F.explode("rows.seen").alias("s")).select(
        F.explode("s").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout, path = prep.layout, scratch_path(spark, "terms")
    spark.createDataFrame([], TERMS).write.parquet(path)
    both = [i for i in range(len(species)) if 0 < seen.get(i, 0) < prep.n]
    one = [i for i in range(len(species)) if i not in set(both)]
    if one:
        never = [[math.inf if seen.get(i, 0) else -math.inf] + [0.0] * len(prep.terms) for i in one]
        frame = [(species[i], t, v) for i, row in zip(one, never)
                 for t, v in zip(["intercept", *prep.terms], row)]
        spark.createDataFrame(frame, TERMS).write.mode("append").parquet(path)
    for group in batched(both, solver.SPECIES):
        theta = solver.solve(packed, layout, group, len(species), [seen[i] / prep.n for i in group])
        coefs = coefficient_frame(spark, theta, [species[i] for i in group], prep)
        if "site" in design.categorical:
            names = spark.createDataFrame([(i, species[i]) for i in group], "species int, species_code string")
            sites = solver.fitted_sites(packed, layout, group, len(species), theta)
            coefs = coefs.unionByName(sites.join(names, "species").select(
                "species_code", F.concat(F.lit("site_"), "site").alias("term"),
                F.col("effect").alias("value")))
        coefs.write.mode("append").parquet(path)
    return spark.read.schema(TERMS).parquet(path)


def fit_ridge(table: DataFrame, species: Sequence[str], support: DataFrame,
              design: Design = Design()) -> DataFrame:
    """All species on the whole table, as long coefficients with support terms."""
    coefs = fit_coefficients(table, species, design)
    codes = table.sparkSession.createDataFrame([(s,) for s in species], "species_code string")
    return coefs.unionByName(support_terms(codes, support))


def holdout_counts(table: DataFrame, species: Sequence[str], by: str, design: Design = Design(),
                   seed: int = P.SEED) -> DataFrame:
    """species_code, p, n, pos, split: how many held-out outings got each score, and
    how many of them had the species. All metrics follow from these, so they are
    what is stored; ``by`` picks the groups that are held out: "site" for places,
    "date" for days. Scores are told apart at nine digits, beyond which they hang on
    the order of sums."""
    group = {"site": "loc_id", "date": "obs_date"}[by]
    scored = holdout_scores(table, species, group, design, seed=seed)
    counts = score_counts(scored.withColumn("p", F.round("p", 9)), ["species_code"])
    return stored(counts.withColumn("split", F.lit(f"by_{by}")), "score-counts")


def evaluate(table: DataFrame, species: Sequence[str], by: str, design: Design = Design(),
             seed: int = P.SEED) -> DataFrame:
    """Hold-out metrics per species and split."""
    return count_metrics(holdout_counts(table, species, by, design, seed), ["split", "species_code"])


#: one column per hour and hardly a penalty: a fitted probability is then the share of
#: detections at that hour, and a level not met in training counts as the first
LEVEL_DESIGN = Design(("hr",), (), drop_first=True, c=1e12)


def balance(table: DataFrame, coefs: DataFrame, design: Design = Design()) -> DataFrame:
    """What each model gives back of the rows it was fitted on, per term.

    At the optimum of a ridge fit the gradient is zero. Over the rows of a
    level, the fitted probabilities plus coefficient / C then equal the
    detections, and those of all rows equal all detections. For a numeric term
    ``fitted`` is the gradient on the standardised values, zero at the optimum.

    Columns: species_code, term, n_rows, fitted. Rows are summed per species
    and level on the map side; only those sums move.
    """
    p = predict(table, coefs, design, keep=[*design.categorical, *design.numeric])
    own = [F.concat(F.lit(_term(c, "")), _level(c)) for c in design.categorical]
    total = (p.select("species_code", F.explode(F.array(F.lit("intercept"), *own)).alias("term"), "p")
             .groupBy("species_code", "term")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("p").alias("fitted")))
    stats = table.agg(
        *[F.avg(c).alias(f"m_{c}") for c in design.numeric],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in design.numeric]).first()
    scale = {c: float(stats[f"s_{c}"]) or 1.0 for c in design.numeric}
    rest = F.col("p") - F.col("y")
    sums = p.groupBy("species_code").agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.sum(rest * (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(scale[c])).alias(f"r_{c}")
        for c in design.numeric])
    numeric = sums.select("species_code", "n_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("term"), F.col(f"r_{c}").alias("fitted"), F.lit(scale[c]).alias("scale"))
        for c in design.numeric])))
    both = total.withColumn("scale", F.lit(1.0)).unionByName(numeric)
    # the intercept bears no penalty
    penalty = F.when(F.col("term") == "intercept", 0.0).otherwise(
        F.coalesce("value", F.lit(0.0)) * F.col("scale") / F.lit(design.c))
    return (both.join(coefs, ["species_code", "term"], "left")
            .select("species_code", "term", "n_rows", (F.col("fitted") + penalty).alias("fitted")))


def holdout_balance(table: DataFrame, species: Sequence[str], group: str,
                    design: Design = Design(), share: float = P.TEST_SHARE, seed: int = P.SEED
                    ) -> DataFrame:
    """Both sides of a hold-out per species: rows and detections held out, and
    what the fit gives back of the rows it was trained on.

    Columns: species_code, n_test, pos_test, n_train, fitted_train.
    """
    split = holdout_split(table, group, share, seed)
    train = split.where(~F.col("is_test"))
    scored = predict(split, fit_coefficients(train, species, design), design,
                     keep=["is_test"])
    held = F.col("is_test")
    return scored.groupBy("species_code").agg(
        F.count_if(held).alias("n_test"), F.count_if(held & (F.col("y") == 1)).alias("pos_test"),
        F.count_if(~held).alias("n_train"),
        F.sum(F.when(~held, F.col("p"))).alias("fitted_train"))


def verdicts(metrics: DataFrame, good: float = P.CAL_GOOD, bad: float = P.CAL_BAD) -> DataFrame:
    """Metrics with the share of detections and a verdict on the mean gap."""
    return (metrics.withColumn("prevalence", F.try_divide(F.col("n_pos").cast("double"), F.col("n")))
            .withColumn("verdict", F.when(F.col("cal_mae") < good, "good")
                        .when(F.col("cal_mae") > bad, "bad")
                        .when(F.col("cal_mae").isNotNull(), "fair")))


def refit(table: DataFrame, species: Sequence[str], support: DataFrame) -> DataFrame:
    """All terms a refit publishes: the fits, hour support, detections, and the
    metrics of both hold-outs."""
    metrics = evaluate(table, species, "site").unionByName(
        evaluate(table, species, "date"))
    found = (table.select(F.explode("seen").alias("species_code"))
             .where(F.col("species_code").isin(list(species))).groupBy("species_code")
             .agg(F.count(F.lit(1)).cast("double").alias("value"))
             .select("species_code", F.lit("meta_detections").alias("term"), "value"))
    return (fit_ridge(table, species, support)
            .unionByName(metric_terms(metrics)).unionByName(found))


def metric_terms(metrics: DataFrame) -> DataFrame:
    """Metrics as published terms, ``meta_<split>_<metric>``."""
    rows = F.array(*[F.struct(F.concat(F.lit("meta_"), F.col("split"), F.lit(f"_{k}")).alias("term"),
                              F.col(k).alias("value")) for k in ("brier", "auc", "cal_mae")])
    return (metrics.select("species_code", F.inline(rows)).where(F.col("value").isNotNull()))
