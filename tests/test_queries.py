from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import SF_DIR, connect, same

QUERIES = {k: q for part in entry.PARTS for k, q in part.QUERIES.items()}
ORACLES = {k: q for part in entry.PARTS for k, q in part.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["image_id", "n_detections"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(QUERIES) == sum(len(part.QUERIES) for part in entry.PARTS)


def test_shuffle_is_a_permutation(spark):
    rows = QUERIES["seeded_shuffle"](spark, SF_DIR).collect()
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.place)] != sorted(r.doc_id for r in rows)
