"""The queries that have SQL against DuckDB, on the smallest tables (or those of ORACLE_SF) and on the awkward rows."""

import os
import shutil

import duckdb
import pytest

from .test_operators import SCHEMA, fixture_rows

D = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    rows = fixture_rows()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/parts")
    part = next(f for f in os.listdir(f"{path}/parts") if f.endswith(".parquet"))
    shutil.move(f"{path}/parts/{part}", f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op9_substrings", "op10_secrets"])
@pytest.mark.parametrize("where", ["tables", "awkward"])
def test_equals_sql(spark, awkward, name, where):
    from shuttleframe.llm import queries

    path = D if where == "tables" else awkward
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, path).select(*rel.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rel.fetchall(), key=key)
