"""Runs a query and its oracle and compares rows, whatever their order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else str(int(f)) if f == int(f) and abs(f) < 1e15 else f"{f:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def assert_same(spark, db, sf, fn, sql):
    df = fn(spark, sf)
    names = sorted(df.columns)
    own = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    found = db.sql(sql)
    at = [list(found.columns).index(n) for n in names]
    other = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(found.columns) == names
    assert own == other
