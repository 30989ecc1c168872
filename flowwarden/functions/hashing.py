"""Row hashes that are the same in every run, engine and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .numeric import col


def row_hash(df: DataFrame, keys: Sequence[str] | None, seed: int) -> Column:
    """md5 text of the seed and the key columns (all columns where none are named)."""
    names = list(keys) if keys else df.columns
    parts = [F.coalesce(col(n).cast("string"), F.lit("\\N")) for n in names]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def unit_interval(text_hash: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of a hash."""
    return F.conv(F.substring(text_hash, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
