import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import oracle, rows

from amplispark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = oracle(sf).sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op2_secret_scans", "op7_quality_rules"])
def test_hard_documents_in_sql(spark, hard_docs, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{hard_docs}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, hard_docs).toPandas()
    assert rows(got) == rows(con.sql(registry.oracle_sql()[name]).df())


DOCUMENT_QUERIES = ["op1_minhash_dedup", "op2_secret_scans", "op3_toxicity", "op6_packing", "op7_quality_rules", "op8_sampled_segmentation", "op9_rendezvous_sharding", "op10_language_id"]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_hard_documents(spark, hard_docs, name):
    n = spark.read.parquet(f"{hard_docs}/documents.parquet").count()
    got = registry.queries()[name](spark, hard_docs).collect()
    if name not in ("op6_packing", "op8_sampled_segmentation"):
        assert len(got) == n
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, -100, None}


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_no_documents(spark, no_docs, name):
    assert registry.queries()[name](spark, no_docs).collect() == []


def test_labels_without_documents(spark, tables):
    from .conftest import DOC_SCHEMA

    at = tables(documents=([(1, "a b", "en", "s", 3, True, 1, 0.5, "x", 1)], DOC_SCHEMA), labels=([(7, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int"))
    assert [(r.doc_id, r.score, r.predicted) for r in registry.queries()["op3_toxicity"](spark, at).collect()] == [(1, 0.0, 0)]
