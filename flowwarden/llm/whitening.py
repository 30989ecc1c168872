"""Embedding whitening from a bit-sliced scatter matrix.

Vectors become whole numbers. Each task packs the bit planes of each dimension, shifted by the task's least
value, across its rows into words; weighted popcounts of ANDed planes are the exact sums of products. Tasks emit
them as whole numbers, Spark adds them, and the covariance is centred in whole numbers before it becomes a matrix
of doubles for ``eigh``. Only sums per pair of dimensions reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Batches, session_of, stored

SCALE = 256
COMPONENTS = 4
#: Rows whose bit planes are packed together.
_BLOCK = 1 << 14
#: Sums travel as limbs of this many bits, so that they add up as decimals without overflow.
_LIMB = 48
_LIMBS = 4


def _width_of(df: DataFrame, column: str) -> int:
    return df.agg(F.max(F.size(column))).first()[0] or 0


def fixed_point(df: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x binary): each vector as 64-bit whole numbers floor(SCALE * entry).

    Left out are NULL vectors, vectors with NULL, NaN or infinite entries, empty ones, and those shorter than the longest.
    """
    vector = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(f"`{key}`").alias("key"), vector.alias("vector")).where(vector.isNotNull() & finite & (F.size(vector) > 0))
    width = _width_of(rows, "vector")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            x = np.floor(SCALE * values).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.where(F.size("vector") == width).mapInArrow(run, f"key {kind}, x binary")


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, width)


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least values, planes, dimension of each plane, bit of each plane): rows are packed into 64-bit words."""
    least = x.min(axis=0)
    shifted = x.astype(np.uint64) - least.astype(np.uint64)
    bits = np.array([int(m).bit_length() for m in shifted.max(axis=0)], dtype=np.int64)
    dims = np.repeat(np.arange(x.shape[1]), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if len(bits) else np.empty(0, dtype=np.int64)
    words = -(-len(x) // 64)
    planes = np.zeros((len(dims), words * 8), dtype=np.uint8)
    for k, (d, b) in enumerate(zip(dims, bit)):
        packed = np.packbits((shifted[:, d] >> np.uint64(b)).astype(np.uint8) & 1)
        planes[k, : len(packed)] = packed
    return least, planes.view(np.uint64), dims, bit


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of the columns and, for i <= j, of their products, from weighted popcounts of ANDed bit planes."""
    n, width = x.shape
    least, planes, dims, bit = bit_planes(x)
    first = np.searchsorted(dims, np.arange(width + 1))
    ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    sums = [sum(int(ones[k]) << int(bit[k]) for k in range(first[d], first[d + 1])) for d in range(width)]
    products = [[0] * width for _ in range(width)]
    # Counts are at most n, so weights below 2^(62 - bits of n) add up in 64 bits; wider ones are added as Python numbers.
    narrow = n.bit_length() + 2 * int(bit.max(initial=0)) + 14 < 63
    weight = np.left_shift(np.int64(1), bit) if narrow else None
    for i in range(width):
        for k in range(first[i], first[i + 1]):
            counts = np.bitwise_count(planes[k] & planes[first[i] :]).sum(axis=1, dtype=np.int64)
            if narrow:
                weighted = counts * weight[first[i] :]
                for j, v in zip(*_by_dimension(weighted, dims[first[i] :])):
                    products[i][j] += int(v) << int(bit[k])
            else:
                for c, j, b in zip(counts.tolist(), dims[first[i] :].tolist(), bit[first[i] :].tolist()):
                    products[i][j] += c << (b + int(bit[k]))
    lows = [int(m) for m in least]
    for i in range(width):
        for j in range(i, width):
            products[i][j] += lows[j] * sums[i] + lows[i] * sums[j] + n * lows[i] * lows[j]
    return [s + n * low for s, low in zip(sums, lows)], products


def _by_dimension(values: np.ndarray, dims: np.ndarray) -> tuple[list[int], list[int]]:
    starts = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else np.empty(0, dtype=np.int64)
    return dims[starts].tolist(), np.add.reduceat(values, starts).tolist() if len(starts) else []


def _limbs(value: int) -> list[int]:
    """Limbs of _LIMB bits, the last with the sign."""
    mask = (1 << _LIMB) - 1
    return [(value >> (_LIMB * k)) & mask if k < _LIMBS - 1 else value >> (_LIMB * k) for k in range(_LIMBS)]


def moments(distinct: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) over the rows of ``distinct`` (x binary), all exact."""

    def run(batches: Batches) -> Batches:
        n, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
        held: list[np.ndarray] = []

        def add() -> None:
            nonlocal n
            if not held:
                return
            x = np.concatenate(held)
            held.clear()
            n += len(x)
            s, p = scatter(x)
            for i in range(width):
                sums[i] += s[i]
                for j in range(i, width):
                    products[i][j] += p[i][j]

        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column(0), width))
            if sum(map(len, held)) >= _BLOCK:
                add()
        add()
        entries = [(-1, -1, n), *[(i, -1, sums[i]) for i in range(width)]]
        entries += [(i, j, products[i][j]) for i in range(width) for j in range(i, width)]
        if n:
            limbs = zip(*[_limbs(v) for _, _, v in entries])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()) for c in zip(*[(i, j) for i, j, _ in entries])] + [pa.array(c, pa.int64()) for c in limbs],
                names=["i", "j", *[f"limb{k}" for k in range(_LIMBS)]])

    names = [f"limb{k}" for k in range(_LIMBS)]
    found = distinct.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} long" for c in names))
    added = found.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names])
    n, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for row in added.collect():
        i, j = row["i"], row["j"]
        value = sum(int(row[c]) << (_LIMB * k) for k, c in enumerate(names))
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            products[i][j] = products[j][i] = value
    return n, sums, products


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """Centred in whole numbers, then divided once: every entry is the double nearest to its exact value."""
    width = len(sums)
    return np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)]).reshape(width, width)


def principal(cov: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by falling eigenvalue; the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


class _Whitener:
    """n * x - S in exact whole numbers, and from it the whitened entries and the deviation."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums = n, sums
        kept = values > len(sums) * np.finfo(float).eps * trace  # a component without variance stays 0
        self.factors = vectors * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        largest = self.n * (int(np.abs(x.astype(object)).max()) if x.dtype == object else max(abs(int(x.min())), abs(int(x.max()))))
        if largest + max(map(abs, self.sums)) < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.factors

    def deviations(self, centred: np.ndarray) -> list[int]:
        if centred.dtype != object:
            largest = max(abs(int(centred.min())), abs(int(centred.max())))
            if largest * largest * centred.shape[1] < 1 << 63:
                return (centred * centred).sum(axis=1).tolist()
            centred = centred.astype(object)
        return (centred * centred).sum(axis=1).tolist()


def _identity_error(distinct: DataFrame, white: _Whitener, width: int, kept: int) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), divisor n, centred before multiplying.

    Each task centres its rows at their own mean; the few numbers of each task are put together at the driver.
    """

    def run(batches: Batches) -> Batches:
        n, mean, spread = 0, np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            if batch.num_rows:
                w = white.whitened(white.centred(_matrix(batch.column(0), width)))
                n, mean, spread = _merged((n, mean, spread), (len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], names=["n", "mean", "spread"])

    total = (0, np.zeros(kept), np.zeros((kept, kept)))
    parts = distinct.select("x").mapInArrow(run, "n long, mean array<double>, spread array<double>")
    for row in sorted(parts.collect()):
        total = _merged(total, (row["n"], np.array(row["mean"]), np.array(row["spread"]).reshape(kept, kept)))
    return float(np.abs(total[2] / total[0] - np.eye(kept)).max())


def _merged(a: tuple, b: tuple) -> tuple:
    if not a[0]:
        return b
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per vector and component, numbered from 1.

    The fit list is each distinct whole-number vector once; n is its length. ``deviation`` is the exact sum of
    (n * x - S)^2 as decimal(38,0). Components are unit eigenvectors of the covariance by falling eigenvalue, signed so
    that their largest entry is positive; ``whitened`` is the centred vector on the component over the root of its
    eigenvalue, ``explained`` the eigenvalue's share of the trace.

    Vectors that are NULL, empty, shorter than the longest, or hold NULL or non-finite entries are left out. Repeated
    rows and NULL keys are rows like others; other columns are not read. A component without variance (constant vectors, fewer
    distinct vectors than dimensions) is whitened to 0, and shows in identity_error. A table without usable vectors gives an
    empty table; with fewer dimensions than ``components`` there are as many components as dimensions.
    """
    spark = session_of(vectors)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = fixed_point(vectors, column, key)
    distinct = stored(rows.select("x").distinct(), "fit_list")
    one = distinct.select(F.octet_length("x").alias("bytes")).limit(1).collect()
    if not one:
        return spark.createDataFrame([], schema)
    width = one[0]["bytes"] // 8
    kept = min(components, width)
    n, sums, products = moments(distinct, width)
    cov = covariance(n, sums, products)
    values, axes = principal(cov, kept)
    trace = float(np.trace(cov))
    white = _Whitener(n, sums, values, axes, trace)
    explained = [float(v) / trace if trace > 0 else 0.0 for v in values]
    error = _identity_error(distinct, white, width, kept)

    def run(batches: Batches) -> Batches:
        from decimal import Decimal

        for batch in batches:
            if not batch.num_rows:
                continue
            centred = white.centred(_matrix(batch.column(1), width))
            m = len(centred)
            deviation = pa.array([Decimal(d) for d in white.deviations(centred)], pa.decimal128(38, 0))
            per_row = pa.array(np.repeat(np.arange(m), kept))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(per_row), pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()), pa.array(np.full(m * kept, n), pa.int64()),
                deviation.take(per_row), pa.array(white.whitened(centred).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
