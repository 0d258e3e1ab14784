"""Every query with a DuckDB equivalent gives the same rows; the others run."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lorekeep.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    rel = duck.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(cols)]) for r in got) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
