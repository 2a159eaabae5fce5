"""Every registered query against its SQL on the smallest provided tables."""

import math

import duckdb
import pytest

from tracefold.plans.catalog import load
from tracefold.plans.views import BASE

DATA = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_matches_sql(spark, con, name):
    df = CATALOG[name].run(spark, DATA)
    want = con.sql(CATALOG[name].oracle())
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.columns, df.collect()) == normal(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.sql])
def test_runs_without_sql(spark, name):
    assert CATALOG[name].run(spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 203  # documents and three empty files
    assert set(entry.oracle_sql()) <= set(entry.queries())
