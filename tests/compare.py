"""Compares a query's rows with its SQL run by DuckDB."""

from __future__ import annotations

import glob
import math
import os

SMALL = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


def connection():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql, con):
    df = query(spark, SMALL)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    q = con.execute(sql)
    assert got == rows([c[0] for c in q.description], q.fetchall())
