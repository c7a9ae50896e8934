"""Every ledger query against its SQL twin in DuckDB, on the smallest folder."""

import datetime
import decimal

import duckdb
import pytest

from ledgerloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    key = lambda row: [(v is None, str(v)) for v in row]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert ours == theirs
