"""Greedy time chains: a start opens a window, the next event at or after its end is the next start.

Both alert suppression and the active cap of a flow are such chains. A chain is
sequential per key, and one key may hold a large part of all events, so a key is
cut into time chunks of a fixed number of windows:

1. Each chunk is summarised on its own: for every possible last start before the
   chunk, the last start at its end. Chains from different entries soon meet, so
   a summary is a short step function.
2. The summaries, a few numbers per chunk, are folded per key in time order,
   which gives every chunk its actual entry.
3. Each chunk is walked once from its entry.

Steps 1 and 3 run in parallel over chunks of the same key. Events of equal key
and time come merged with a count, so a chunk never has more rows than it has
milliseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.batches import group_starts, whole_groups

CHUNK_WINDOWS = 20
#: windows from one chunk of a frame to the next on their common axis
APART = CHUNK_WINDOWS + 2
_EARLIEST = np.iinfo(np.int64).min
_NONE = _EARLIEST // 2


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _placed(pdf: pd.DataFrame, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(group number, place) of every row: the chunks of a frame on one axis, too far apart for a window to reach the next."""
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    since = pdf["_t"].fillna(0).to_numpy(np.int64) - pdf["_chunk"].fillna(0).to_numpy(np.int64) * (window * CHUNK_WINDOWS)
    return group, np.where(pdf["_t"].isna(), 0, since) + group * (window * APART)


def _following(place: np.ndarray, group: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Per row the next row at least a window later, or the row after its group."""
    return np.minimum(np.searchsorted(place, place + window), ends[group])


def _summarise(keys: Sequence[str], window: int):
    groups = [*keys, "_chunk"]

    def run(batches):
        for pdf in whole_groups(batches, groups):
            bounds = group_starts(pdf, groups)
            group, place = _placed(pdf, bounds, window)
            times = pdf["_t"].fillna(_EARLIEST).to_numpy(np.int64)
            ends = bounds[1:]
            following = _following(place, group, ends, window)
            early = place - group * (window * APART) < window
            first = early | np.append(True, early[:-1])
            first[bounds[:-1]] = True
            first = np.flatnonzero(first)
            owner, at = group[first], first
            while True:
                step = following[at]
                inside = step < ends[owner]
                if not inside.any():
                    break
                at = np.where(inside, step, at)
            keep = np.append((at[1:] != at[:-1]) | (owner[1:] != owner[:-1]), True)
            entry, exit_ = times[first[keep]], times[at[keep]]
            cuts = np.searchsorted(owner[keep], np.arange(len(bounds))).tolist()
            spans = list(zip(cuts[:-1], cuts[1:]))
            out = pdf.iloc[bounds[:-1]][groups].reset_index(drop=True)
            yield out.assign(_entry=[entry[i:j] for i, j in spans], _exit=[exit_[i:j] for i, j in spans])

    return run


def _fold(keys: Sequence[str], window: int):
    def run(batches):
        key, last = None, _NONE
        for pdf in batches:
            found = []
            rows = zip(zip(*[pdf[k] for k in keys]), pdf["_entry"], pdf["_exit"])
            for this, entry, exit_ in rows:
                if this != key:
                    key, last = this, _NONE
                found.append(last)
                i = np.searchsorted(entry, last + window)
                if i < len(entry):
                    last = int(exit_[i])
            yield pdf[[*keys, "_chunk"]].assign(_last=np.array(found, dtype=np.int64))

    return run


def _walk(keys: Sequence[str], window: int, every_event: bool):
    groups = [*keys, "_chunk"]

    def run(batches):
        for pdf in whole_groups(batches, groups):
            bounds = group_starts(pdf, groups)
            # the first row of a group carries its entry, the events follow
            head, ends, numbers = bounds[:-1], bounds[1:], np.arange(len(bounds) - 1)
            group, place = _placed(pdf, bounds, window)
            place[head] = (numbers * APART - 1) * window
            times = pdf["_t"].fillna(0).to_numpy(np.int64)
            lasts = pdf["_last"].fillna(_NONE).to_numpy(np.int64)[head]
            before = np.concatenate([[0], np.cumsum(pdf["_n"].to_numpy(np.int64))])
            following = _following(place, group, ends, window)
            begin = pdf["_chunk"].fillna(0).to_numpy(np.int64)[head] * (window * CHUNK_WINDOWS)
            opens = np.clip(lasts + window - begin, 1 - window, (APART - 1) * window) + numbers * (window * APART)
            at, owner, found = np.clip(np.searchsorted(place, opens), head + 1, ends), numbers, [np.empty(0, dtype=np.int64)]
            while len(at):
                inside = at < ends[owner]
                at, owner = at[inside], owner[inside]
                found.append(at)
                at = following[at]
            starts = np.sort(np.concatenate(found))
            if every_event:
                latest = np.full(len(pdf), -1)
                latest[starts] = starts
                latest = np.maximum.accumulate(latest)
                opened = np.where(latest > head[group], times[latest], lasts[group])
                rows = np.delete(np.arange(len(pdf)), head)
                start, since = pd.array(opened[rows], dtype="Int64"), np.zeros(len(rows), dtype=np.int64)
            else:
                own, closed = group[starts], before[head + 1]
                since = before[starts] - np.where(np.append(False, own[1:] == own[:-1]), np.append(0, before[starts[:-1]] + 1), closed[own])
                closed[own] = before[starts] + 1
                rest = before[ends] - closed
                held = np.flatnonzero(rest > 0)
                rows, since = np.append(starts, head[held]), np.append(since, rest[held])
                start = pd.array(np.append(times[starts], np.zeros(len(held), dtype=np.int64)), dtype="Int64")
                start[len(starts):] = pd.NA
            out = pdf.iloc[rows][[*groups, "_t"]].reset_index(drop=True)
            yield out.assign(_start=start, _since=since)

    return run


def _chain(events: DataFrame, keys: Sequence[str], window: int, every_event: bool) -> DataFrame:
    keys = list(keys)
    groups = [*keys, "_chunk"]
    cut = events.withColumn("_chunk", F.floor(F.col("_t") / F.lit(window * CHUNK_WINDOWS)).cast("bigint"))
    # the same columns as below, so that one exchange of the merged events serves both
    placed = cut.select(*groups, "_t", "_n").repartition(*groups).sortWithinPartitions(*groups, "_t")
    arrays = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("_entry", "_exit")]
    summaries = placed.mapInPandas(_summarise(keys, window), T.StructType([*_fields(cut, groups), *arrays]))
    folded = (
        summaries.repartition(*keys).sortWithinPartitions(*groups)
        .mapInPandas(_fold(keys, window), T.StructType([*_fields(cut, groups), _long("_last")]))
    )
    none = F.lit(None).cast("bigint")
    both = cut.select(*groups, "_t", "_n", none.alias("_last")).unionByName(
        folded.select(*groups, none.alias("_t"), F.lit(0).cast("bigint").alias("_n"), "_last")
    )
    return (
        both.repartition(*groups).sortWithinPartitions(*groups, F.asc_nulls_first("_t"))
        .mapInPandas(
            _walk(keys, window, every_event),
            T.StructType([*_fields(cut, groups), _long("_t"), _long("_start"), _long("_since")]),
        )
    )


def chain_starts(events: DataFrame, keys: Sequence[str], window_ms: int) -> DataFrame:
    """Starts of every chain.

    ``events`` has the keys, ``_t`` (milliseconds) and ``_n`` (events of that
    time), one row per key and time. The result has one row per start with
    ``_since``, the events passed over since the previous start inside its
    chunk, and a row with NULL ``_start`` per chunk for those after its last start.
    """
    return _chain(events, keys, window_ms, every_event=False)


def chain_owner(events: DataFrame, keys: Sequence[str], window_ms: int) -> DataFrame:
    """Every event time with the start (``_start``) of the chain window it lies in."""
    return _chain(events, keys, window_ms, every_event=True).select(*keys, "_t", "_start")
