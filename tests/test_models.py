"""Ridge fits, hold-outs, metrics and hour coding against numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions.splines import inner_probabilities
from fieldcast.operators import evaluation, hourcoding, labels, modelling, ranks, solver
from tests.test_expressions import brute_basis

N = 900


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    df = pd.DataFrame({
        "sub_id": [f"s{i}" for i in range(N)], "hour": rng.uniform(5.6, 11.4, N),
        "doy": rng.integers(1, 40, N), "site": rng.choice(["H1", "H2", "PERSONAL"], N, p=[.2, .2, .6]),
        "log_dur": rng.normal(0, .5, N), "log_dist": rng.uniform(0, 2, N),
        "n_observers": rng.integers(1, 5, N), "traveling": rng.integers(0, 2, N),
        "wind_max": rng.uniform(0, 30, N), "temp_mean": rng.normal(15, 5, N),
        "precip_sum": rng.exponential(1, N), "cloud_mean": rng.uniform(0, 100, N)})
    df["hr"] = np.rint(df.hour).astype(int)
    df["week"] = df.doy // 7
    df["loc_id"] = np.where(df.site == "PERSONAL", [f"L{i % 40}" for i in range(N)], df.site)
    df["obs_date"] = [dt.date(2024, 1, 1) + dt.timedelta(days=int(d) - 1) for d in df.doy]
    df["lat"], df["lon"] = rng.uniform(40, 41, N), rng.uniform(-81, -80, N)
    z = -0.5 + df.log_dur - 0.05 * df.wind_max + 0.5 * (df.site == "H1") + 0.1 * (df.hr - 8)
    for name, shift in (("spa", 0.0), ("spb", -0.7)):
        df[name] = (rng.uniform(0, 1, N) < 1 / (1 + np.exp(-(z + shift)))).astype(int)
    return df


@pytest.fixture(scope="module")
def table(spark, frame):
    seen = F.array_compact(F.array(*[F.when(F.col(s) == 1, F.lit(s)) for s in ("spa", "spb")]))
    return spark.createDataFrame(frame).withColumn("seen", seen).drop("spa", "spb").cache()


def design(df, drop_first=False, categorical=("hr", "week", "site"), numeric=P.NUMERIC):
    cols, names = [], []
    for c in categorical:
        for v in sorted(df[c].unique())[1 if drop_first else 0:]:
            cols.append((df[c] == v).to_numpy(float))
            names.append((c, v))
    mu, sd = df[list(numeric)].mean(), df[list(numeric)].std(ddof=0)
    for c in numeric:
        cols.append(((df[c] - mu[c]) / sd[c]).to_numpy())
        names.append(("num", c))
    return np.stack(cols, 1), names, mu, sd


def newton(x, y, c=1.0):
    """Ridge logit with a free intercept, solved to machine precision."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    pen = np.full(x1.shape[1], 1.0 / c if c else 0.0)
    pen[0] = 0.0
    b = np.zeros(x1.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ b))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pen),
                               x1.T @ (p - y) + pen * b)
        b -= step
    return b[0], b[1:], x1


def raw_terms(df, species, **kw):
    x, names, mu, sd = design(df, **kw)
    b0, b, _ = newton(x, df[species].to_numpy(float))
    key = {"hr": "hour_%02d", "week": "week_%02d", "site": "site_%s"}
    out = {"intercept": b0}
    for (kind, v), beta in zip(names, b):
        if kind == "num":
            out[v] = beta / sd[v]
            out["intercept"] -= beta * mu[v] / sd[v]
        else:
            out[key[kind] % v] = beta
    return out


def test_ridge_equals_newton(spark, frame, table):
    support = labels.hour_support(table, 50)
    got = modelling.fit_ridge(table, ["spa", "spb"], support).toPandas()
    for s in ("spa", "spb"):
        have = dict(got[got.species_code == s][["term", "value"]].values)
        want = raw_terms(frame, s)
        sup = {f"support_{h:02d}": n for h, n in frame.hr.value_counts().items() if n >= 50}
        assert set(have) == set(want) | set(sup)
        assert max(abs(have[k] - v) for k, v in want.items()) < 1e-5
        assert all(have[k] == v for k, v in sup.items())


def test_split_sites_give_the_same_fit(spark, frame, table, monkeypatch):
    # sites of several blocks keep a number between steps, others are solved in their task
    monkeypatch.setattr(modelling, "BLOCK_ROWS", 64)
    monkeypatch.setattr(solver, "CHUNK", 100)
    sparse = table.withColumn("site", F.when(F.col("site") == "PERSONAL", F.col("loc_id"))
                              .otherwise(F.col("site")))
    prep = modelling.prepare(sparse)
    assert set(prep.hot) == {"H1", "H2"} and min(prep.hot.values()) > 1
    got = {r["term"]: r["value"] for r in modelling.fit_coefficients(sparse, ["spb"]).collect()}
    want = raw_terms(frame.assign(site=np.where(frame.site == "PERSONAL", frame.loc_id, frame.site)), "spb")
    assert set(got) == set(want) and max(abs(got[k] - v) for k, v in want.items()) < 1e-8


def test_passes_do_not_grow_with_species(table, monkeypatch):
    passes = []
    one_pass = solver._sums
    monkeypatch.setattr(solver, "_sums", lambda *a: passes.append(len(a[2])) or one_pass(*a))
    modelling.fit_coefficients(table, ["spa"]).count()
    alone = len(passes)
    modelling.fit_coefficients(table, ["spa", "spb", "absent"]).count()
    assert alone <= 12 and len(passes) - alone <= alone + 2 and max(passes) == 2


def test_species_of_one_class(table):
    got = {(r["species_code"], r["term"]): r["value"] for r in
           modelling.fit_coefficients(table, ["spa", "absent"]).collect()}
    assert got["absent", "intercept"] == -math.inf and got["absent", "log_dur"] == 0.0
    coefs = modelling.fit_coefficients(table, ["absent"])
    assert modelling.predict(table, coefs).agg(F.max("p")).first()[0] == 0.0


def test_site_effects_solve_their_equation():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 30, (500, 4))
    y = (rng.uniform(0, 1, z.shape) < 0.3).astype(float)
    starts = np.array([0, 1, 5, 300])
    a = solver.site_effects(z, y, starts, 0.01)
    site = np.repeat(np.arange(4), [1, 4, 295, 200])
    p = 1 / (1 + np.exp(-(z + a[site])))
    assert np.abs(np.add.reduceat(p - y, starts, axis=0) + 0.01 * a).max() < 1e-8


def test_calibration_variant_drops_first_levels(spark, frame, table):
    d = modelling.CALIBRATION_DESIGN
    got = dict((r["term"], r["value"]) for r in
               modelling.fit_coefficients(table, ["spa"], d).collect())
    want = raw_terms(frame, "spa", drop_first=True, categorical=d.categorical, numeric=d.numeric)
    assert set(got) == set(want) and "week_00" not in got
    # the coordinates have tiny spread, so raw units magnify solver error
    assert max(abs(got[k] - v) for k, v in want.items() if k != "intercept") < 1e-4


def test_prediction_ignores_unknown_levels(spark, frame, table):
    coefs = modelling.fit_coefficients(table.where("site <> 'H2' and hr <> 7"), ["spa"])
    terms = {r["term"]: r["value"] for r in coefs.collect()}
    assert "site_H2" not in terms and "hour_07" not in terms
    row = frame[(frame.site == "H2") & (frame.hr == 7)].iloc[0]
    got = modelling.predict(table.where(F.col("sub_id") == row.sub_id), coefs).first()
    z = terms["intercept"] + terms[f"week_{row.week:02d}"] + sum(terms[c] * row[c] for c in P.NUMERIC)
    assert got["p"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert got["y"] == row.spa


@pytest.mark.parametrize("by,group", [("site", "loc_id"), ("date", "obs_date")])
def test_whole_groups_are_held_out(table, frame, by, group):
    split = evaluation.group_holdout(table, group).toPandas()
    groups = frame[group].nunique()
    assert len(split) == groups and split.is_test.sum() == math.ceil(0.25 * groups)
    again = evaluation.group_holdout(table, group, seed=1).toPandas()
    merged = split.merge(again, on=group)
    assert (merged.is_test_x != merged.is_test_y).any()
    m = modelling.evaluate(table, ["spa", "spb"], by).toPandas()
    assert set(m.species_code) == {"spa", "spb"} and m.auc.between(0.5, 1).all()
    assert (m.brier < 0.25).all() and set(m.split) == {f"by_{by}"}


def brute_metrics(p, y, bins=10):
    p, y = np.asarray(p), np.asarray(y)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    ap = sum((y[p == t].sum() / y.sum()) * y[p >= t].mean() for t in np.unique(p))
    edges = np.unique(np.quantile(p, np.arange(bins + 1) / bins))
    mae = None
    if len(edges) > 1:
        b = np.maximum((edges[None] < p[:, None]).sum(1), 1)
        mae = np.mean([abs(p[b == k].mean() - y[b == k].mean()) for k in np.unique(b)])
    return np.mean((p - y) ** 2), auc, ap, mae


@pytest.mark.parametrize("kind", ["smooth", "ties", "packed", "constant", "ends"])
def test_metrics_equal_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    n = 400
    p = {"smooth": rng.uniform(0, 1, n), "ties": rng.integers(1, 9, n) / 10,
         "packed": 1e-4 + rng.uniform(0, 1e-6, n), "constant": np.full(n, .3),
         "ends": rng.choice([0.0, 0.5, 1.0], n)}[kind]
    y = (rng.uniform(0, 1, n) < 0.4).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "p": p, "y": y}))
    got = evaluation.eval_metrics(df, ["g"]).first()
    brier, auc, ap, mae = brute_metrics(p, y)
    assert got["brier"] == pytest.approx(brier) and got["auc"] == pytest.approx(auc)
    assert got["avg_precision"] == pytest.approx(ap)
    assert got["cal_mae"] == (None if mae is None else pytest.approx(mae))


@pytest.mark.parametrize("p,auc", [([.1, .2, .8, .9], 1), ([.9, .8, .2, .1], 0), ([.5] * 4, .5)])
def test_auc_extremes(spark, p, auc):
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "p": p, "y": [0, 0, 1, 1]}))
    assert evaluation.eval_metrics(df, ["g"]).first()["auc"] == auc


def test_one_class_gives_nulls(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "p": [.1, .2], "y": [0, 0]}))
    r = evaluation.eval_metrics(df, ["g"]).first()
    assert [r[c] for c in ("brier", "auc", "avg_precision", "cal_mae")] == [None] * 4
    s = evaluation.eval_summary(evaluation.eval_metrics(df, ["g"]), "g").first()
    assert s["n_species"] == 1 and s["mean_auc"] is None


def test_repeated_edges_merge(spark):
    p = [.1, .1, .1, .1, .2, .3]
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "p": p, "y": 0}))
    ranked = evaluation._ranked(evaluation.score_counts(df, ["g"]), ["g"])
    got = {r["p"]: r["bin"] for r in ranks.quantile_bins(ranked, ["g"], "p", 3).collect()}
    assert got == {.1: 0, .2: 1, .3: 1}


def test_quantiles_of_any_sign_and_scale(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1e6, 200), rng.normal(0, 1e-6, 200), [0.0] * 7])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = {r["k"]: r["value"] for r in ranks.quantiles(df, [], "x", 10).collect()}
    np.testing.assert_allclose([got[k] for k in range(11)], np.quantile(x, np.arange(11) / 10),
                               rtol=1e-9, atol=1e-15)


def glm(frame, hours, spline):
    df = frame[frame.hr.isin(hours)]
    def basis(c, n):
        lo, hi = [float(df[c].min())] * 4, [float(df[c].max())] * 4
        return brute_basis(df[c], lo + list(np.quantile(df[c], inner_probabilities(n))) + hi)[:, 1:]
    x = [df[["log_dur", "log_dist"]].to_numpy(), basis("doy", 3),
         df[["wind_max", "temp_mean", "precip_sum"]].to_numpy()]
    x.append(basis("hour", 4) if spline else
             np.stack([(df.hr == h).to_numpy(float) for h in hours if h != 8], 1))
    x = np.hstack(x)
    b0, b, x1 = newton(x, df.spa.to_numpy(float), c=None)
    p = 1 / (1 + np.exp(-x1 @ np.r_[b0, b]))
    y = df.spa.to_numpy()
    ll = np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    m = y.mean()
    null = len(y) * (m * math.log(m) + (1 - m) * math.log(1 - m))
    cov = np.linalg.inv((x1 * (p * (1 - p))[:, None]).T @ x1)
    return b0, b, 2 * (x.shape[1] + 1) - 2 * ll, 1 - ll / null, np.sqrt(np.diag(cov)), x.shape[1]


def test_hour_codings(spark, frame, table):
    n = frame.hr.value_counts()
    hours = sorted(h for h in n.index if 5 <= h <= 20 and n[h] >= 50)
    got = {r["coding"]: r for r in hourcoding.hour_coding(table, "spa").collect()}
    for name, spline in (("spline", True), ("dummy", False)):
        _, _, aic, r2, _, k = glm(frame, hours, spline)
        assert got[name]["params"] == k
        assert got[name]["aic"] == pytest.approx(aic, rel=1e-7)
        assert got[name]["pseudo_r2"] == pytest.approx(r2, rel=1e-6)


def test_odds_ratios(spark, frame, table):
    n = frame.hr.value_counts()
    hours = sorted(h for h in n.index if 5 <= h <= 20 and n[h] >= 50)
    _, b, _, _, se, _ = glm(frame, hours, False)
    got = {r["hr"]: r for r in hourcoding.odds_ratios(table, "spa").collect()}
    others = [h for h in hours if h != 8]
    assert sorted(got) == hours and got[8]["odds_ratio"] == 1.0 and got[8]["p_value"] is None
    for i, h in enumerate(others):
        beta, err = b[-len(others) + i], se[1:][-len(others) + i]
        assert got[h]["odds_ratio"] == pytest.approx(math.exp(beta), rel=1e-5)
        assert got[h]["p_value"] == pytest.approx(math.erfc(abs(beta / err) / math.sqrt(2)), rel=1e-3)
        assert got[h]["n"] == n[h]


def test_worked_example_adds_up(spark, table):
    got = {r["hr"]: r for r in hourcoding.worked_example(table, "spa").collect()}
    assert got[8]["hour_term"] == 0.0 and got[8]["is_reference"]
    for r in got.values():
        assert r["total"] - r["hour_term"] == pytest.approx(got[8]["total"])
        assert r["probability"] == pytest.approx(1 / (1 + math.exp(-r["total"])))


def test_few_stored_files_are_scored_by_several_tasks(spark, table):
    one = spark.createDataFrame([(s, t, 0.1) for s in ("spa", "spb") for t in P.SCALAR_TERMS],
                                "species_code string, term string, value double")
    p = modelling.predict(table.coalesce(1), one, modelling.Design(("hr", "week")))
    assert p.count() == 2 * N
    assert p.select(F.spark_partition_id()).distinct().count() > 1


def test_a_site_of_one_block_is_small_in_a_large_table():
    assert modelling._several_blocks(1 << 30) <= 1 << 16
    assert modelling._several_blocks(1000) == modelling.BLOCK_ROWS
