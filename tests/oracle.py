"""Compares registered queries with their SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def same(spark, con, query, sql: str, sf_dir: str = SF_DIR) -> None:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want and got
