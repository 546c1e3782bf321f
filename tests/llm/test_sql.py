"""Registered queries against their SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from cellspan.llm import queries

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    have = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(have)
    assert sorted((tuple(r[n] for n in have) for r in got.collect()), key=repr) == want
