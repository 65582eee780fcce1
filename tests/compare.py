"""Order-insensitive comparison of two result frames."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return (1, str(bool(value)))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (int, float)):
        return (2, f"{float(value):.9g}")
    return (3, str(value))


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def compare(got: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} != {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)} rows"
    for mine, theirs in zip(rows_of(got), rows_of(expected)):
        if mine != theirs:
            return f"\n  got      {mine}\n  expected {theirs}"
    return None
