"""Runs registered queries beside their SQL and compares rows as the driver does: columns by name, rows in any order."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def compare(con, df, sql):
    """None, or what differs."""
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} for {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} rows for {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
