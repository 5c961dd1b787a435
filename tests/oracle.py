"""Comparison of a query with its SQL counterpart in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def assert_same(spark, query, sql, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in names) for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    places = [columns.index(c) for c in names]
    want = [tuple(norm(r[i]) for i in places) for r in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)
