"""Rows as sorted tuples, alike for Spark and DuckDB."""

from __future__ import annotations

import pandas as pd


def cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "~"
    if isinstance(v, float):
        return round(v, 5)
    return pd.Timestamp(v).isoformat() if isinstance(v, pd.Timestamp) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
