import os

import pytest

import corpus_pipeline
from slotloom.llm import pii
from slotloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    found, expected = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    names = sorted(found.columns)
    at = [expected.columns.index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in expected.fetchall())


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, DATA)
    first, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        if name != "encode":
            assert docs.columns == columns
        if name == "language":
            assert docs.count() == first  # clean documents stay
        if name == "personal_data":
            left = pii.find_spans(docs).selectExpr("size(base) n").groupBy().sum("n").first()[0]
            assert left == 0
    assert 0 < docs.count() and docs.where("n_tokens = 0").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "encode"]


def test_empty_documents(spark):
    docs = corpus_pipeline.documents(spark, DATA).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
