"""Each query with SQL against DuckDB, on the small table."""

import os

import pytest

from prefscope.llm.oracle import ORACLE
from prefscope.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not there")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, DIR)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    key = lambda row: tuple((x is None, str(x)) for x in row)
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    b = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall(), key=key)
    assert a == b
