"""Every registered query on cells against its SQL in DuckDB."""

import os

import duckdb
import pytest

from cellspan import cell_queries

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(cell_queries.queries()))
def test_query_matches_sql(spark, duck, name):
    got = cell_queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    cur = duck.execute(cell_queries.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    want = sorted((tuple(dict(zip(have, r, strict=True))[n] for n in names) for r in cur.fetchall()), key=repr)
    assert rows == want
