"""Every registered query runs; those with SQL give the same rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from fieldcast.plans import catalog, oracle

QUERIES, SQL = catalog.registered(), oracle.statements()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# fits need more rows than the smallest tables have
ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


def canonical(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float, Decimal)):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_every_statement_has_its_query():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(SQL) <= set(QUERIES)
    assert ROWS_ONLY == ["calibrate_metrics", "calibrate_models", "evaluate_models", "fit_ridge"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    res = duck.execute(SQL[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canonical(res.fetchall(), columns)


@pytest.mark.parametrize("name", ["fitted_species", "presence_absence", "hour_contrasts",
                                  "hour_coding_check", "fit_ridge_check", "hour_coding", "odds_ratios",
                                  "worked_example", "spline_values", "holdout_metrics_check"])
def test_same_rows_above_the_floors(spark, name):
    """The smallest tables pass no floor; these pass them."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    res = con.execute(SQL[name])
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got and got == canonical(res.fetchall(), [c[0] for c in res.description])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs_on_few_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).collect() is not None


def test_entry_is_not_empty(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    df = contract.entry(spark)
    assert df.columns and df.limit(1).count() == 1
