"""Queries against their SQL, as the driver does it: names, row counts and sorted values."""

from __future__ import annotations

import math

import duckdb

from tidewater.sources.domain import BASE


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "normalize"):  # Decimal
        return float(x)
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, list | tuple):
        return tuple(map(_value, x))
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    return con


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows: {bad[:2]}" if bad else None
