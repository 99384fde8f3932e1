"""Every query that has SQL against DuckDB, on the smallest tables; the others must run and keep their schema."""

import math

import duckdb
import pytest

from leafmill.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_search_on_larger_tables(spark, sf):
    """Stems that the smallest table doesn't have."""
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    assert sorted(r.doc_id for r in QUERIES["fts_porter"](spark, f"/root/testdata/{sf}").collect()) == sorted(r[0] for r in con.sql(ORACLES["fts_porter"]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_imports_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
