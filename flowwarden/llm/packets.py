"""Exchanging columns of numbers between tasks as packed blocks.

One row of a plain shuffle costs far more than the few bytes of a signature. The
map side therefore packs, per target partition, all its numbers into one binary
row; Spark moves the rows with ``repartitionById``, and the reduce side reads
them back as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "part int, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("payload", pa.binary())])


def pack(columns: Sequence[np.ndarray]) -> bytes:
    """Arrays of any lengths as one block of bytes."""
    head = np.array([len(columns), *[len(c) for c in columns]], dtype=np.int64).tobytes()
    return b"".join([head, *[np.ascontiguousarray(c).tobytes() for c in columns]])


def unpack(payload: bytes, dtypes: Sequence[str]) -> list[np.ndarray]:
    lengths = np.frombuffer(payload, dtype=np.int64, count=1 + len(dtypes))[1:]
    at, out = 8 * (1 + len(dtypes)), []
    for n, d in zip(lengths, dtypes):
        out.append(np.frombuffer(payload, dtype=d, count=int(n), offset=at))
        at += int(n) * np.dtype(d).itemsize
    return out


def split_rows(part: np.ndarray, columns: Sequence[np.ndarray], parts: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows dealt out to their partitions."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    sorted_columns = [c[order] for c in columns]
    for p in range(parts):
        a, b = bounds[p], bounds[p + 1]
        if a < b:
            yield p, [c[a:b] for c in sorted_columns]


def batch_of(rows: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, payloads = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], schema=_ARROW)


def exchange(packets: DataFrame, parts: int) -> DataFrame:
    return packets.repartitionById(parts, "part")
