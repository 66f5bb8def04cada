"""Order-insensitive comparison of a Spark result with a DuckDB oracle."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ratecast.plans.tables import TABLES


def _num(v):
    v = round(float(v), 5)
    return int(v) if v.is_integer() else v


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if s.dtype.kind == "f":
            df[c] = s.round(5).map(lambda v: None if pd.isna(v) else (int(v) if float(v).is_integer() else v))
        elif s.dtype == object:
            df[c] = s.map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v))
                          else (v.isoformat() if hasattr(v, "isoformat") and not hasattr(v, "hour") else
                                (v.isoformat(sep=" ") if hasattr(v, "isoformat") else None)) if hasattr(v, "isoformat")
                          else (_num(v) if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, bool) else
                                (str(v) if not isinstance(v, (list, np.ndarray, dict)) else str(list(v)))))
        elif s.dtype.kind in "iu" or str(s.dtype).startswith(("Int", "UInt")):
            df[c] = s.map(lambda v: None if pd.isna(v) else int(v))
        elif s.dtype.kind == "M":
            df[c] = s.map(lambda v: None if pd.isna(v) else (v.date().isoformat() if v == v.normalize()
                                                             else v.isoformat(sep=" ")))
    return df.astype(str)


def duckdb_views(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


RTOL, ATOL = 1e-9, 1e-9


def _floats(df: pd.DataFrame) -> list[str]:
    return [c for c in df.columns if df[c].dtype.kind == "f"
            or (df[c].dtype == object and df[c].map(lambda v: isinstance(v, float)).any())]


def compare(sp: pd.DataFrame, ora: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference.
    Doubles are compared unrounded, with a relative tolerance."""
    if sorted(sp.columns) != sorted(ora.columns):
        return f"columns differ: {sorted(sp.columns)} vs {sorted(ora.columns)}"
    if len(sp) != len(ora):
        return f"row counts differ: {len(sp)} vs {len(ora)}"
    loose = sorted(set(_floats(sp)) | set(_floats(ora)))
    exact = [c for c in sorted(sp.columns) if c not in loose]

    def ordered(raw):
        # rows are matched by their exact columns, then by roughly rounded doubles
        raw = raw[sorted(raw.columns)].reset_index(drop=True)
        key = norm(raw)
        for c in loose:
            key[c] = pd.to_numeric(raw[c], errors="coerce").map(lambda v: f"{v:+.6e}")
        at = key.sort_values(exact + loose).index
        return raw.loc[at].reset_index(drop=True), key.loc[at].reset_index(drop=True)

    (ra, ka), (rb, kb) = ordered(sp), ordered(ora)
    if not ka[exact].equals(kb[exact]):
        i = int((ka[exact] != kb[exact]).any(axis=1).idxmax())
        return f"values differ: {ka.iloc[i].to_dict()} vs {kb.iloc[i].to_dict()}"
    for c in loose:
        x, y = (pd.to_numeric(r[c], errors="coerce").to_numpy(float) for r in (ra, rb))
        bad = ~np.isclose(x, y, rtol=RTOL, atol=ATOL, equal_nan=True)
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            return f"{c} differs in {int(bad.sum())} rows: {ka.iloc[i].to_dict()} vs {kb.iloc[i].to_dict()}"
    return None
