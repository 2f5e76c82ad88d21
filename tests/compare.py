"""Spark rows against DuckDB rows of the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6f}"
    if x is None:
        return "\0"
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, int) and not isinstance(x, bool):
        return str(x)
    return str(x)


def same_rows(df, sql: str, con) -> int:
    """Assert equal columns and rows; return the number of rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    got = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, wrong[:3]
    return len(got)
