"""Every registered query with SQL against DuckDB, on the smallest tables (or those of ORACLE_SF)."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from shuttleframe import catalog

D = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, D)
    rel = duck.sql(catalog.oracle_sql()[name])
    want = table(rel.columns, rel.fetchall())
    have = table(got.columns, [tuple(r) for r in got.collect()])
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1]) > 0
    assert have[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, D).count() > 0
