"""Runs registered queries in Spark and their oracle in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def compare(spark_df, con, sql: str) -> str | None:
    """None where both results agree, else a short description of the difference."""
    cols = sorted(spark_df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in cur.fetchall()]
    key = lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        return None if got else "both empty"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    g, w = bad[0]
    return f"{len(bad)} rows differ, first: " + str({c: (a, b) for c, a, b in zip(cols, g, w) if a != b})
