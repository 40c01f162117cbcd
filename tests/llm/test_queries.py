"""The registered queries on the small tables: against DuckDB where there is SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_by_brute_force(spark):
    from tests.llm.test_lines import brute as brute_lines
    from tests.llm.test_neardup import brute as brute_near
    from tests.llm.test_phrases import brute as brute_phrases

    from graphloom.llm.quality import THRESHOLD, op9

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in op9(spark, SF).collect() if r.score >= THRESHOLD}
    lines = {i: kept for i, _, _, kept in brute_lines([(i, t) for i, t in docs.items() if i in good])}
    first = {i for i, _, _, kept in brute_near(list(lines.items())) if kept}
    clean = {i for i, _, hit, _ in brute_phrases([(i, lines[i]) for i in first], items) if not hit}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == clean
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256(lines[i].encode()).hexdigest() for i, r in out.items())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
