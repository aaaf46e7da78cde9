from __future__ import annotations

import pytest

import bench
from boxloom.llm import entry
from tests.oracle import SF_DIR, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, entry.QUERIES[name], entry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(entry.QUERIES.keys() - entry.ORACLES.keys()))
def test_query_covers_its_whole_table(spark, name):
    table = "pages" if name.startswith("op3_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    want = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in entry.QUERIES[name](spark, SF_DIR).select(key).collect()} == want


def test_the_bench_counts_corpus_queries():
    corpus = {n for n in bench.HEADLINE if n.startswith("op")}
    assert {"op1_line_dedup", "op2_simhash", "op4_decontaminate", "op10_url_filter"} <= corpus <= entry.QUERIES.keys()
