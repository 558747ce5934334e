"""Compare a Spark result with the result of the SQL on the same files."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float) or hasattr(value, "dtype") and value.dtype.kind == "f":
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, (bool,)) or hasattr(value, "dtype") and value.dtype.kind == "b":
        return bool(value)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "tolist"):
        return value.tolist()
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = [tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def close(a, b) -> bool:
    return a == b


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {
        c: (got[c].dtype.kind, want[c].dtype.kind)
        for c in got.columns
        if got[c].dtype.kind in "ifb" and want[c].dtype.kind in "ifb" and got[c].dtype.kind != want[c].dtype.kind
    }
    if kinds:
        return f"types differ: {kinds}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None
