"""The strongest wind among events whose numbers pass a million, as its SQL orders them."""

import duckdb

import __spark_entry__ as entry

from .compare import assert_same


def test_wind_maximum_beyond_a_million_events(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT * REPLACE (999000 + event_id * 3 AS event_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'""")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    sql = entry.oracle_sql()["wind_maximum"]
    assert max(r[0] for r in db.sql(f"SELECT event_id FROM ({sql})").fetchall()) >= 1_000_000
    assert_same(spark, db, str(tmp_path), entry.queries()["wind_maximum"], sql)
