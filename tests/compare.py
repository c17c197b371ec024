"""Spark rows against DuckDB rows of the same query."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differ(df, con, sql) -> str:
    """'' if both agree, else what differs."""
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if have[0] != want[0]:
        return f"columns {have[0]} against {want[0]}"
    if len(have[1]) != len(want[1]):
        return f"{len(have[1])} rows against {len(want[1])}"
    return next((f"{a} against {b}" for a, b in zip(have[1], want[1]) if a != b), "")
