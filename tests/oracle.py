"""Compare a query with its SQL check on a small data folder."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, int) else str(v)


def close(x, y):
    if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
        return abs(x - y) <= 2e-6 * max(1, abs(x))
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(close(a, b) for a, b in zip(x, y))
    return x == y


def key(row):
    return tuple((x is None, f"{x:.4f}" if isinstance(x, float) else str(x)) for x in row)


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()), key=key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not close(a, b)]
    assert not bad, bad[:3]
