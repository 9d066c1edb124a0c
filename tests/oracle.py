"""Compares a query's rows with those of its DuckDB SQL on the same tables."""

import datetime
import decimal
import glob
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def same(spark, sf_dir, query, sql):
    """The number of rows; fails if the rows differ."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    c = connect(sf_dir)
    rows = c.execute(sql).fetchall()
    columns = [d[0] for d in c.description]
    assert sorted(columns) == names, (columns, names)
    at = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
