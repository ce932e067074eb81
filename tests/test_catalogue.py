"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from paperloom.plans import catalogue

SF = "/root/testdata/sf0.001"
Q, SQL = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:19] if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = Q[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = db.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(Q) == set(SQL) <= set(entry.queries())
