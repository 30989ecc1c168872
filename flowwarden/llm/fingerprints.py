"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its s-mers is the first or the last one.
That depends on the k-mer alone, so equal passages have equal anchors whatever stands around
them. A fingerprint keeps every anchor of a text with its place, for set likeness and for matching
passages by position, so it grows with the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Batches, key_of_doc, session_of, shuffle_partitions, text_of
from .words import mix

K, S = 16, 8
_BASE = 0xD1342543DE82EF95
_SEGMENT = 1 << 19
_HASH_BITS, _GAP_BITS = 48, 16
_U = np.uint64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=_U), np.full(n, pow(_BASE, -1, 1 << 64), dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _anchors_of(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of one stretch of code points."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, _U)
    up, down = _powers(1 << (n - 1).bit_length())
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((codes.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    small = mix((sums[s:] - sums[: n - s + 1]) * down[: n - s + 1])
    width = k - s + 1
    low, reach = small, 1
    while reach * 2 <= width:
        low, reach = np.minimum(low[: len(low) - reach], low[reach:]), reach * 2
    if reach < width:
        low = np.minimum(low[: n - k + 1], low[width - reach : width - reach + n - k + 1])
    low = low[: n - k + 1]
    at = np.flatnonzero((small[: n - k + 1] == low) | (small[k - s : k - s + n - k + 1] == low))
    return at, mix((sums[at + k] - sums[at]) * down[at]) >> _U(64 - _HASH_BITS)


def anchors(texts: Sequence[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of each text's closed syncmers, all of them in the order of their places.

    A text of fewer than k code points has itself as its one anchor; an empty text has none.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at, hashes = [], []
    for first in range(0, len(codes), _SEGMENT):
        a, h = _anchors_of(codes[first : first + _SEGMENT + k - 1], k, s)
        at.append(a + first)
        hashes.append(h)
    place = np.concatenate([*at, np.empty(0, np.int64)])
    value = np.concatenate([*hashes, np.empty(0, _U)])
    owner = np.searchsorted(ends, place, "right")
    inside = place + k <= (ends[owner] if len(ends) else place)
    place, value, owner = place[inside], value[inside], owner[inside]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        start = ends[i] - lengths[i]
        if 0 < lengths[i] < k:
            digest = hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out.append((np.array([int.from_bytes(digest) >> (64 - _HASH_BITS)], dtype=_U), np.zeros(1, np.int64)))
        else:
            out.append((value[a:b], place[a:b] - start))
    return out


def encode(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of one little-endian 64-bit word per anchor: its hash (high 48 bits) and its distance from the anchor before.

    Of k - s + 1 successive k-mers one at least is an anchor, so the distances are small.
    """
    gaps = np.diff(found[1], prepend=0)
    if len(gaps) and gaps.max() >> _GAP_BITS:
        raise ValueError("anchors too far apart")
    return base64.b64encode((found[0] << _U(_GAP_BITS) | gaps.astype(_U)).astype("<u8").tobytes()).decode("ascii")


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(base64.b64decode(fingerprint), dtype="<u8").astype(_U)
    return words >> _U(_GAP_BITS), np.cumsum((words & _U((1 << _GAP_BITS) - 1)).astype(np.int64))


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sets of hashes (distinct)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """The share of distinct anchors that two texts have in common, 2 |A and B| / (|A| + |B|); 1 for two empty texts, 0 for one."""
    return _likeness(np.unique(decode(a)[0]), np.unique(decode(b)[0]))


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Places (in a, in b) of all pairs of equal anchors, in order."""
    (ha, pa_), (hb, pb) = decode(a), decode(b)
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    n = high - low
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return list(zip(np.repeat(pa_, n).tolist(), pb[order][np.repeat(low, n) + nth].tolist()))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs`` (doc_id, text); NULL counts as the empty text."""
    session_of(docs)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [encode(x) for x in anchors(batch.column(1).to_pylist(), k, s)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_following(docs: DataFrame) -> DataFrame:
    """(range, flag, doc_id, id, hash, text), laid out so that in each range a row's successor comes next.

    Rows are in order of doc_id (NULL first), then of a hash of the text. Each range ends with a copy
    (flag 1) of the first row of the next range; the last range ends with the first row of all. Only the
    first key of each range passes through the driver, at most one per shuffle partition.
    """
    spark = session_of(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of_doc().alias("id"), F.xxhash64(text_of(docs)).alias("hash"), text_of(docs).alias("text"))
    ranged = keyed.select("id", "hash").repartitionByRange(shuffle_partitions(spark), "id", "hash")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "hash")).alias("low"))
    low = sorted((r["low"]["id"], r["low"]["hash"]) for r in firsts.collect())
    ids, hashes = np.array([x[0] for x in low], dtype=np.int64), np.array([x[1] for x in low], dtype=np.int64)
    count = max(1, len(low))

    @F.pandas_udf("long")
    def place(i: pd.Series, h: pd.Series) -> pd.Series:
        a, b = i.to_numpy(np.int64), h.to_numpy(np.int64)
        left, right = np.searchsorted(ids, a, "left"), np.searchsorted(ids, a, "right")
        at = right - 1
        # Several ranges begin inside one id: its hashes decide.
        for k in np.flatnonzero(right > left):
            at[k] = left[k] + np.searchsorted(hashes[left[k] : right[k]], b[k], "right") - 1
        at = np.maximum(at, 0)
        return pd.Series(at * 2 + ((ids[at] == a) & (hashes[at] == b)))

    spots = F.when(F.col("_at") % 2 == 1, F.array(
        F.struct(F.floor(F.col("_at") / 2).cast("int").alias("range"), F.lit(0).alias("flag")),
        F.struct(F.pmod(F.floor(F.col("_at") / 2) - 1, F.lit(count)).cast("int").alias("range"), F.lit(1).alias("flag")),
    )).otherwise(F.array(F.struct(F.floor(F.col("_at") / 2).cast("int").alias("range"), F.lit(0).alias("flag"))))
    dealt = keyed.withColumn("_at", place("id", "hash")).withColumn("_spot", F.explode(spots))
    rows = dealt.select("_spot.range", "_spot.flag", "doc_id", "id", "hash", "text")
    return rows.repartitionById(count, "range").sortWithinPartitions("range", "flag", "id", "hash")


def compare_with_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, per row of ``docs`` (doc_id, text).

    The edited text has its last half replaced by the beginning of the next document's text; after the last
    document comes the first, and a single row follows itself. NULL is the empty text; repeated rows follow
    each other; an empty table gives an empty result. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """

    def rows_of(doc, text, found, distinct, following, next_distinct):
        changed = [edited(t, f) for t, f in zip(text, following)]
        new = anchors(changed, k, s)
        return pa.RecordBatch.from_arrays([
            pa.array(doc, pa.int64()), pa.array([len(t) for t in text], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([encode(x) for x in found]), pa.array([encode(x) for x in new]),
            pa.array([_likeness(x, np.unique(y[0])) for x, y in zip(distinct, new)], pa.float64()),
            pa.array([_likeness(x, y) for x, y in zip(distinct, next_distinct)], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Batches) -> Batches:
        held = None  # the last row so far: (range, doc_id, text, anchors, their distinct hashes), None after a range has ended
        for batch in batches:
            part, flag, doc, text = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
            found = anchors(text, k, s)
            distinct = [np.unique(x[0]) for x in found]
            if held is not None:
                part, flag, doc, text = [held[0], *part], [0, *flag], [held[1], *doc], [held[2], *text]
                found, distinct = [held[3], *found], [held[4], *distinct]
            own = [i for i in range(len(part) - 1) if flag[i] == 0]
            if any(part[i] != part[i + 1] for i in own):
                raise ValueError("a range without its end")
            for a in range(0, len(own), 500):
                some = own[a : a + 500]
                yield rows_of([doc[i] for i in some], [text[i] for i in some], [found[i] for i in some], [distinct[i] for i in some],
                              [text[i + 1] for i in some], [distinct[i + 1] for i in some])
            held = (part[-1], doc[-1], text[-1], found[-1], distinct[-1]) if flag[-1] == 0 else None

    return with_following(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
