"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}/**')" if p.is_dir() else f"create view {t} as select * from read_parquet('{p}')")
    return con


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for k in df:
        if str(df[k].dtype).startswith("datetime"):
            df[k] = df[k].astype("datetime64[us]").astype(str)
    df = df.astype(object).where(df.notna(), None)
    return sorted((tuple(None if v is None else round(float(v), 5) if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in df.itertuples(index=False)), key=str)
