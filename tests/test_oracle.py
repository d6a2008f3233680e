"""Every registered query that has SQL against DuckDB on the same tables; the others by their rows."""

import duckdb
import pytest

from lexweave.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(tidy, x))
    return x


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, sf, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tidy(tuple(r)) for r in df.select(columns).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tidy(r) for r in duck.execute(f"SELECT {names} FROM ({Q.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_without_sql(spark, sf):
    assert Q.QUERIES["model_extraction"](spark, sf).count() > 0
    assert set(Q.QUERIES) - set(Q.ORACLE_SQL) == {"model_extraction", "resolve_fold", "resolve_micro_batches", "random_pick"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
