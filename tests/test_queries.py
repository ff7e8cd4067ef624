"""Every registered query that has SQL gives that SQL's rows, on the smallest tables."""

import math

import duckdb
import pytest

from contractlake.plans import queries
from contractlake.plans.bindings import TABLES


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or not hasattr(v, "__float__"):
        return str(v)
    return f"{float(v):.9g}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, engine, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name not in queries.ORACLES:
        assert df.count() >= 0
        return
    want = engine.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
