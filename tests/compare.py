"""Comparison of a query's rows with DuckDB's over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, bool) or str(type(v)).endswith("bool'>"):
            return bool(v)
        return float(v) if not isinstance(v, str) else v

    return sorted((tuple(one(v) for v in row) for row in df.itertuples(index=False)), key=repr)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """What differs first, or nothing. Values must be equal, columns too."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = _plain(mine), _plain(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    return next((f"{sum(p != q for p, q in zip(a, b, strict=True))} rows, first {x} and {y}" for x, y in zip(a, b, strict=True) if x != y), "")
