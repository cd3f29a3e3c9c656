"""Registered queries against their SQL, where there is one, on the smallest tables."""

import os

import pytest

from stateloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ours = queries.queries()[name](spark, DATA)
    theirs = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    told = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert told(ours.select(*columns).collect()) == told(theirs.fetchall())


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
