"""Row-by-row comparison of a query with its SQL oracle."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_frame(sql: str, folder: str) -> pd.DataFrame:
    with duckdb.connect() as db:
        for name in TABLES:
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        return db.execute(sql).df()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else repr(v))
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} != {sorted(wanted.columns)}"
    a, b = canonical(got), canonical(wanted)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            i = bad.idxmax()
            return f"column {c}, {int(bad.sum())} rows: {a[c][i]} != {b[c][i]} ({got[c].dtype}, {wanted[c].dtype})"
    kinds = {c: (str(got[c].dtype), str(wanted[c].dtype)) for c in a.columns if got[c].dtype.kind != wanted[c].dtype.kind}
    return f"types {kinds}" if kinds else None
