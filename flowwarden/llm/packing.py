"""Best-fit packing of token pieces with swap-based local search.

Documents are tokenised where they lie; only piece lengths travel. Pieces are dealt out at
random to groups of bounded size, each packed in one task: best fit in falling size first,
then pieces move, change places one for one or two for one between underfull sequences, each
step raising the sum of squared fills, until the emptiest sequences are empty.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import Batches, session_of, stored, text_of

CAPACITY = 2048
END = 0
GROUP_PIECES = 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids as a numpy array, equal to the tokenizers library's for this file.

    A byte-level BPE file whose ids follow its merges is run by tiktoken, which gives the same ids
    several times faster; any other file is run by the tokenizers library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][t] for t in joined] == list(range(256, 256 + len(joined))):
            fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: only the first may be shorter than the capacity."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal[, key, ids]) per piece; ``deal`` is a random number, ``key`` one of its own."""
    ids_too = ", key long, ids binary" if keep_ids else ""

    def run(batches: Batches) -> Batches:
        encode = encoder(path)
        task = TaskContext.get()
        seed = task.partitionId() if task else 0
        rng = np.random.default_rng(seed)
        key = seed << 40
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), END).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(data), data)):
                        column.append(value)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(out, types)]
            arrays.append(pa.array(rng.integers(0, 1 << 62, len(out[0])), pa.int64()))
            if keep_ids:
                arrays += [pa.array(np.arange(key, key + len(out[0]))), pa.array(out[5], pa.binary())]
                names += ["key", "ids"]
                key += len(out[0])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, piece int, start long, length long, ids_crc32 long, deal long{ids_too}")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items in falling size, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has gap g
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = gaps >> s
        if fits:
            g = s + (fits & -fits).bit_length() - 1
            b = by_gap[g].pop()
            if not by_gap[g]:
                gaps ^= 1 << g
        else:
            g, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rest = g - s
        if rest:
            if not by_gap[rest]:
                gaps |= 1 << rest
            by_gap[rest].append(b)
    return bins


class _Index:
    """Bins by a number that they hold, each list sorted by gap; ``room`` is the largest gap per number."""

    def __init__(self, capacity: int):
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.room = np.full(capacity + 1, -1, dtype=np.int64)

    def add(self, number: int, gap: int, b: int) -> None:
        insort(self.bins[number], (gap, b))
        self.room[number] = self.bins[number][-1][0]

    def drop(self, number: int, gap: int, b: int) -> None:
        entries = self.bins[number]
        del entries[bisect_left(entries, (gap, b))]
        self.room[number] = entries[-1][0] if entries else -1

    def exchange(self, total: int, donor_gap: int) -> tuple[int, int, int]:
        """(gain, number, bin): the largest gain of a bin that gives ``number`` for ``total`` and is then fuller than the donor was."""
        for number in (np.flatnonzero(self.room[1:total] >= np.arange(total - 1, 0, -1)) + 1).tolist():
            gain, entries = total - number, self.bins[number]
            k = bisect_left(entries, (gain, -1))
            if entries[k][0] < donor_gap + gain:
                return gain, number, entries[k][1]
        return 0, 0, -1


class _Search:
    """Local search over the underfull bins of one group."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.size, self.capacity, self.steps = sizes.tolist(), capacity, 0
        self.bins = [list(b) for b in bins]
        self.gap = np.array([capacity - sum(self.size[i] for i in b) for b in self.bins], dtype=np.int64)
        self.spare = int(self.gap.sum())
        self.free: list[tuple[int, int]] = []
        self.waiting: list[tuple[int, int]] = []
        self.singles, self.pairs = _Index(capacity), _Index(capacity)
        for b in range(len(self.bins)):
            self._enter(b)

    def _numbers(self, b: int) -> tuple[list[int], set[int]]:
        """Distinct sizes of a bin, largest first, and distinct sums of two of its items; the capacity bounds both."""
        count = Counter(self.size[i] for i in self.bins[b])
        distinct = sorted(count, reverse=True)
        sums = {x + y for j, x in enumerate(distinct) for y in distinct[j + 1 :]}
        return distinct, sums | {2 * x for x in distinct if count[x] > 1}

    def _items(self, b: int, total: int, two: bool) -> list[int]:
        """One item of bin ``b`` of size ``total``, or two items of that sum."""
        at: dict[int, int] = {}
        for i in self.bins[b]:
            if not two and self.size[i] == total:
                return [i]
            if two and total - self.size[i] in at:
                return [i, at[total - self.size[i]]]
            at[self.size[i]] = i
        raise ValueError("the index names a bin without such items")

    def _enter(self, b: int) -> None:
        if self.bins[b] and self.gap[b] > 0:
            gap, (singles, pairs) = int(self.gap[b]), self._numbers(b)
            insort(self.free, (gap, b))
            for n in singles:
                self.singles.add(n, gap, b)
            for n in pairs:
                self.pairs.add(n, gap, b)

    def _leave(self, b: int) -> None:
        if self.bins[b] and self.gap[b] > 0:
            gap, (singles, pairs) = int(self.gap[b]), self._numbers(b)
            del self.free[bisect_left(self.free, (gap, b))]
            for n in singles:
                self.singles.drop(n, gap, b)
            for n in pairs:
                self.pairs.drop(n, gap, b)

    def _exchange(self, donor: int, given: list[int], other: int, got: list[int]) -> None:
        """One step: ``given`` go from ``donor`` to ``other``, ``got`` come back (none of them: a move)."""
        self._leave(other)
        self.bins[donor] = [i for i in self.bins[donor] if i not in given] + got
        self.bins[other] = [i for i in self.bins[other] if i not in got] + given
        gain = sum(self.size[i] for i in given) - sum(self.size[i] for i in got)
        self.gap[donor] += gain
        self.gap[other] -= gain
        if not self.bins[donor]:
            self.spare -= self.capacity
        self.steps += 1
        self._enter(other)

    def _step(self, donor: int) -> int | None:
        """The move into the tightest gap, else the exchange of largest gain, that raises squared fill: the other bin, None without one."""
        gap, (singles, pairs) = int(self.gap[donor]), self._numbers(donor)
        for size in singles:
            k = bisect_left(self.free, (size, -1))
            if k < len(self.free) and self.free[k][0] < gap + size:
                other = self.free[k][1]
                self._exchange(donor, self._items(donor, size, False), other, [])
                return other
        best, step = 0, None
        for totals, two, index, back in ((singles, False, self.singles, False), (singles, False, self.pairs, True), (pairs, True, self.singles, False)):
            for total in totals:
                gain, number, other = index.exchange(total, gap)
                if gain > best:
                    best, step = gain, (total, two, other, number, back)
        if step is None:
            return None
        total, two, other, number, back = step
        self._exchange(donor, self._items(donor, total, two), other, self._items(other, number, back))
        return other

    def empty(self, donor: int, again: bool) -> None:
        """Improve until the donor is empty or no step is left for it; with ``again`` bins that change wait as donors at their new gap."""
        self._leave(donor)
        while self.bins[donor]:
            other = self._step(donor)
            if other is None:
                break
            if again and self.gap[other] > 0:
                heappush(self.waiting, (-int(self.gap[other]), other))
        self._enter(donor)


def _searched(bins: list[list[int]], sizes: np.ndarray, capacity: int, fresh: bool) -> list[list[int]]:
    """``bins`` after passes over all of them, each the donor once a pass, until a pass makes no step.

    The emptiest come first: as they stood when the pass began, or (``fresh``) as they stand now.
    """
    search = _Search(bins, sizes, capacity)
    steps = -1
    while search.spare >= capacity and steps != search.steps:
        steps, tried = search.steps, set()
        search.waiting = [(-int(g), b) for b, g in enumerate(search.gap) if search.bins[b] and g > 0]
        heapify(search.waiting)
        while search.waiting and search.spare >= capacity:
            gap, donor = heappop(search.waiting)
            if donor not in tried and search.bins[donor] and (not fresh or -gap == search.gap[donor] > 0):
                tried.add(donor)
                search.empty(donor, fresh)
    return [b for b in search.bins if b]


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Fewer bins: the emptiest are taken apart one after the other, until no step raises squared fill.

    It ends earlier only where the gaps together are smaller than one bin: no packing has fewer bins then.
    Where two orders of donors end in different packings, the one of fewer bins is taken.
    """
    fills = [int(sizes[b].sum()) for b in bins]
    full = [b for b, f in zip(bins, fills) if f == capacity]
    rest = [b for b, f in zip(bins, fills) if f < capacity]
    found = _searched(rest, sizes, capacity, True)
    least = -(-sum(f for f in fills if f < capacity) // capacity)
    return full + (found if len(found) == least else min(found, _searched(rest, sizes, capacity, False), key=len))


def _pack_group(capacity: int, columns: list[str]):
    def run(batches: Batches) -> Batches:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        groups = table.column("part").to_numpy()
        for g in np.unique(groups).tolist():
            part = table.filter(pa.array(groups == g))
            sizes = part.column("length").to_numpy().astype(np.int64)
            whole, others = np.flatnonzero(sizes == capacity), np.flatnonzero(sizes < capacity)
            bins = best_fit(sizes[others], capacity)
            bins = local_search(bins, sizes[others], capacity)
            packed = [[int(others[i]) for i in b] for b in bins] + [[int(i)] for i in whole]
            order = np.array([i for b in packed for i in b], dtype=np.int64)
            number = np.repeat(np.arange(len(packed), dtype=np.int64), [len(b) for b in packed])
            ends = np.cumsum(sizes[order])
            first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            before = (ends - sizes[order])[first]
            offset = ends - sizes[order] - np.repeat(before, np.diff(np.append(first, len(order))))
            part = part.take(pa.array(order)).select(columns)
            part = part.append_column("sequence_id", pa.array((g << 32) + number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from part.combine_chunks().to_batches(max_chunksize=20_000)

    return run


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece of ``docs`` (doc_id, text).

    A document is its ids followed by id 0 (NULL and empty texts: id 0 alone); documents longer than
    ``capacity`` are cut into pieces of that length, the first of which may be shorter. Every piece has one
    place in one sequence, gapless from offset 0. Repeated rows and NULL ids are packed like others. An empty
    table gives an empty result. With ``keep_ids`` each piece carries its ids (little-endian unsigned 32-bit);
    they join the placed pieces and never pass through a packing task.
    """
    session_of(docs)
    pieces = stored(token_pieces(docs, path or tokenizer_path(), capacity, keep_ids), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["key"] * keep_ids]
    dealt = pieces.select(*columns, F.pmod("deal", F.lit(groups)).cast("int").alias("part"))
    key = "key long, " if keep_ids else ""
    placed = dealt.repartitionById(groups, "part").mapInArrow(
        _pack_group(capacity, columns), f"doc_id long, piece int, start long, length long, ids_crc32 long, {key}sequence_id long, offset long")
    return placed.join(pieces.select("key", "ids"), "key").drop("key") if keep_ids else placed


def joined_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences of pieces that carry their ids, as little-endian unsigned 32-bit ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def sequences(docs: DataFrame, plan: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids) of a plan without ids, from the texts again; doc_id must be unique and not NULL."""
    ids = token_pieces(docs, path or tokenizer_path(), capacity, keep_ids=True).select("doc_id", "piece", "ids")
    return joined_sequences(plan.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"]))
