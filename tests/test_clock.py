"""Times of day beyond a hundred hours."""

import duckdb

from shuttleframe import catalog


def test_clock_of_late_requests_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/part.parquet') TO '{tmp_path}/part.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (event_id * 4999 AS event_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    for name in ("part", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.sql(catalog.oracle_sql()["e23_clock"])
    got = catalog.queries()["e23_clock"](spark, str(tmp_path)).select(*want.columns).collect()
    assert max(r["s"] for r in got) > 400 * 3600 and sorted(map(tuple, got)) == sorted(want.fetchall())
