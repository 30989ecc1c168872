"""Words and word hashes of many texts at once, with numpy.

A word is a maximal run of characters other than the six ASCII white-space
characters; A-Z count as a-z. Hashes are 64-bit polynomial hashes of the UTF-8
bytes, taken from prefix sums, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything of ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def word_hashes(
    texts: Sequence[bytes], separators: np.ndarray = _SPACE, prefixes: Sequence[int] = ()
) -> tuple[np.ndarray, ...]:
    """Word hashes in order, the number of each word's text, and each word's line number inside the batch.

    Lines are cut at ``\\n`` and numbered through the batch; text i starts at line ``first_lines(texts)[i]``.
    ``separators`` says which bytes part words; it must include ``\\n``. For each n of ``prefixes`` follow the
    hashes of the words' first n bytes.
    """
    joined = b"\n".join(texts).lower() + b"\n"
    buf = np.frombuffer(joined, dtype=np.uint8)
    space = np.frombuffer(joined.translate(separators.tobytes()), dtype=bool)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    short = [np.empty(len(starts), dtype=np.uint64) for _ in prefixes]
    at = 0
    while at < len(starts):
        first = starts[at]
        stop = max(int(np.searchsorted(ends, first + _BLOCK, "right")), at + 1)
        last = ends[stop - 1]
        n = int(last - first)
        power, inverse = _powers(max(_BLOCK, 1 << (n - 1).bit_length()))
        sums = np.zeros(n + 1, dtype=np.uint64)
        values = np.take(_BYTE, buf[first:last])
        values *= power[:n]
        np.cumsum(values, out=sums[1:])
        s = starts[at:stop] - first
        out[at:stop] = (sums[ends[at:stop] - first] - sums[s]) * inverse[s]
        for k, size in enumerate(prefixes):
            e = np.minimum(ends[at:stop] - first, s + size)
            short[k][at:stop] = (sums[e] - sums[s]) * inverse[s]
        at = stop
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    doc = _places(np.cumsum(lengths), starts)
    line = _places(np.flatnonzero(buf == 0x0A), starts)
    return mix(out), doc, line, *[mix(x) for x in short]


def _places(bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of ``bounds`` come before each of ``starts``; both are sorted."""
    before = np.searchsorted(starts, bounds, "left")
    return np.repeat(np.arange(len(bounds) + 1), np.diff(before, prepend=0, append=len(starts)))


def first_lines(texts: Sequence[bytes]) -> np.ndarray:
    """The batch-wide number of each text's first line."""
    counts = np.fromiter((t.count(b"\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def group_bounds(sorted_ids: np.ndarray, n: int) -> np.ndarray:
    """Start of each id 0..n-1 in a sorted array, plus its length."""
    return np.searchsorted(sorted_ids, np.arange(n + 1))


def shingle_sets(texts: Sequence[bytes], size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words has its whole word sequence as its one shingle; a text without words has none.
    """
    words, doc, _ = word_hashes(texts)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    bounds = group_bounds(doc, len(texts))
    n = len(words) - size + 1
    if n > 0:
        rolled = words[:n] * weights[0]
        for j in range(1, size):
            rolled += words[j : j + n] * weights[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        m = int(b - a)
        if m >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif m:
            short = words[a:b] * weights[:m]
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(m * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def texts_of(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes; NULL is the empty text."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
