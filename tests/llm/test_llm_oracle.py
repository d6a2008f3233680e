"""Registered queries of this package that have SQL against DuckDB on the same tables."""

import duckdb
import pytest

from lexweave.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({Q.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want
