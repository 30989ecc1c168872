"""Joining a table against a derived lookup whose size is known only at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
SALTS = 64


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = None
    for k in keys:
        match = left[f"`{k}`"].eqNullSafe(renamed[f"`_right_{k}`"])
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def join_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join to a materialised lookup table; NULL keys match NULL keys.

    Up to ``max_rows`` the lookup is broadcast. Beyond that the rows of ``df`` are
    spread over salts and the lookup is repeated once per salt, so that a key
    holding a large share of the rows is still split over many tasks.
    """
    if lookup.limit(max_rows + 1).count() <= max_rows:
        right, on, side = F.broadcast(lookup), list(keys), df
        salted: list[str] = []
    else:
        side = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int"))
        right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on, salted = [*keys, "_salt"], ["_salt"]
    return null_safe_join(side, right, on, how).drop(*salted)
