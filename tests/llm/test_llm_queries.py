"""Registered queries of the package: SQL where there is some, and the pipeline."""

import duckdb
import pytest

from fieldcast.llm import oracle, queries
from tests.llm.frames import documents
from tests.test_queries import TABLES, canonical

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.registered()[name](spark, sf)
    res = con.execute(oracle.statements()[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got and got == canonical(res.fetchall(), columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_every_query_is_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.registered())
    assert numbers == list(range(1, 14))


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{i}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert 0 < docs.count() <= seen
            seen = docs.count()
    assert docs.select("doc_id").distinct().count() == seen
    fill = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in fill) <= 4096


def test_pipeline_on_odd_rows(spark, sf):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
