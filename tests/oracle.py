"""Run a registered query and its SQL on the same parquet files and compare whole results."""

from __future__ import annotations

import math

import duckdb

from fellscan.registered.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [names[i] for i in order]


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    left, lnames = _table([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    right, rnames = _table(cur.fetchall(), [d[0] for d in cur.description])
    if lnames != rnames:
        return f"columns differ: {lnames} | {rnames}", len(left)
    if len(left) != len(right):
        return f"row counts differ: {len(left)} | {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]} | {[type(x).__name__ for x in bad[0][0]]} {[type(x).__name__ for x in bad[0][1]]}", len(left)
    return "ok", len(left)
