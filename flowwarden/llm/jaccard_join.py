"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size share a size band. Within a band two similar sets differ in at
most k elements, so when the feature domain is cut into more than k partitions, the
sets agree on a whole partition; the content of each partition is one signature.
(Subsets of second-level partitions are enumerated with subset size one here: word
shingles are rare enough that a single partition is selective, and k + 1 is the
smallest number of signatures that PartEnum allows.)

Empty partitions and signatures of more than ``HOT`` different sets are not joined on.
That loses no pair in which one side keeps more usable signatures than the pair may
differ in. Sets that keep fewer are compared among themselves in blocks, on bitmaps: first
each with its smallest possible partner, then only across the components so found.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import packets
from .graph import components
from .store import Batches, key_of_doc, session_of, shuffle_partitions, stored, text_of, whole_row
from .words import mix, shingle_sets, texts_of

HOT = 16
CHUNK = 2_000
BLOCK = 4_096
FEW_KEYS = 500_000
_U = np.uint64


class Bands:
    """Size bands for a similarity of ``percent``/100: partners lie in the same or the neighbouring band."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1, 2]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * 100 // percent + 1))

    def differing(self, total):
        """The most elements in which two similar sets of ``total`` elements together differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, partitions, usable signatures needed) for each band in which a set of n elements has partners."""
        own = bisect_right(self.low, n) - 1
        out = []
        for band in (own, own + 1):
            largest = min(self.low[band + 1] - 1, n * 100 // self.percent)
            if largest >= self.low[band]:
                k = self.differing(2 * (self.low[band + 1] - 1))
                parts = 1 if k == 0 else int(1.1 * (k + 1) + 0.5 * (k + 1) ** 0.5 + 2)
                out.append((band, parts, self.differing(n + largest) + 1))
        return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit identity of a set; the empty set has 0."""
    if not len(s):
        return 0
    total = mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U, keepdims=True) + _U(len(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return int(mix(total).view(np.int64)[0]) or 1


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, entry) per non-empty partition, and (set, band, slack) per entry, one entry per set and band."""
    sig, entry, owner, of_band, slack = [], [], [], [], []
    for i, s in enumerate(sets):
        if not len(s):
            continue
        spread, content = (s >> _U(7)) % _U(1 << 40), mix(s)
        for band, parts, needed in bands.of(len(s)):
            slot = (spread % _U(parts)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            at = slot[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums = np.add.reduceat(content[order], first)
            sig.append(mix(sums + mix(at[first].astype(_U) + _U(band << 32))))
            entry.append(np.full(len(first), len(owner), dtype=np.int64))
            owner.append(i)
            of_band.append(band)
            slack.append(len(first) - needed)
    if not sig:
        return (np.empty(0, _U), *[np.empty(0, np.int64)] * 4)
    return np.concatenate(sig), np.concatenate(entry), np.array(owner), np.array(of_band), np.array(slack)


_PACKET = ("u4", "u2", "u2", "i8", "i2", "u1")
_MARK = 0xFFFF


def _emit(bands: Bands, parts: int, most: int):
    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            sets, keys = [], []
            for s in shingle_sets(texts_of(batch.column(0))):
                key = set_key(s)
                if key and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    keys.append(key)
            sig, entry, owner, band, slack = signatures(sets, bands)
            if not len(sig):
                continue
            order = np.argsort(sig)
            ordered = sig[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            count = np.diff(np.append(first, len(ordered)))
            crowded = np.repeat(count > most, count)
            hot_entries = entry[order[crowded]]
            slack = slack - np.bincount(hot_entries, minlength=len(slack))
            marks = ordered[first[count > most]]
            sig = np.concatenate([ordered[~crowded], marks])
            entry = np.concatenate([entry[order[~crowded]], np.full(len(marks), -1)])
            # Entries whose every signature is crowded still have to report their slack.
            silent = np.setdiff1d(np.flatnonzero(slack < 0), entry)
            sig = np.concatenate([sig, mix(silent.astype(_U))])
            entry = np.concatenate([entry, -2 - silent])
            rows = []
            key_of = np.array(keys, dtype=np.int64)[owner]
            for p, (h, e) in packets.split_rows((sig % _U(parts)).astype(np.int64), [sig // _U(parts), entry], parts):
                alone = e <= -2
                present, local = np.unique(e[(e >= 0)], return_inverse=True)
                index = np.full(len(e), _MARK, dtype=np.uint16)
                index[e >= 0] = local
                table = np.concatenate([present, -2 - e[alone]])
                keep = ~alone
                rows.append((p, packets.pack([
                    (h[keep] >> _U(16)).astype(np.uint32), (h[keep] & _U(0xFFFF)).astype(np.uint16), index[keep],
                    key_of[table], np.clip(slack[table], -32768, 32767).astype(np.int16), band[table].astype(np.uint8),
                ])))
            yield packets.batch_of(rows)

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("slack", pa.int32()), ("hot", pa.int64())])


def _rows(kind: int, a, b, slack=None, hot=None) -> pa.RecordBatch:
    n = len(a)
    zero = np.zeros(n, dtype=np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)),
        pa.array((zero if slack is None else slack).astype(np.int32)), pa.array((zero if hot is None else hot).astype(np.int64)),
    ], schema=_FOUND)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    new &= low != high
    return low[new], high[new]


def _meet(batches: Batches, most: int) -> Batches:
    """All signatures of one partition: pairs from signatures of at most ``most`` sets, counts of hot ones per set."""
    sigs, entries, keys, slacks, bands, at = [], [], [], [], [], 0
    for batch in batches:
        for payload in batch.column(1).to_pylist():
            hi, lo, index, key, slack, band = packets.unpack(payload, _PACKET)
            sigs.append((hi.astype(_U) << _U(16)) | lo)
            e = index.astype(np.int64) + at
            e[index == _MARK] = -1
            entries.append(e)
            keys.append(key)
            slacks.append(slack)
            bands.append(band)
            at += len(key)
    if not sigs:
        return
    key, slack, band = np.concatenate(keys), np.concatenate(slacks), np.concatenate(bands)
    sig = np.concatenate(sigs)
    sigs.clear()
    order = np.argsort(sig)
    sig, entry = sig[order], np.concatenate(entries)[order]
    same = np.zeros(len(sig) + 1, dtype=bool)
    same[1:-1] = sig[1:] == sig[:-1]
    several = np.flatnonzero(same[1:] | same[:-1])
    # A set that several tasks have sent counts once in each signature.
    held_by = np.where(entry[several] < 0, 0, key[entry[several]]) if len(key) else np.zeros(len(several), np.int64)
    fine = several[np.lexsort((held_by, sig[several]))]
    held_by = np.where(entry[fine] < 0, 0, key[entry[fine]]) if len(key) else np.zeros(len(fine), np.int64)
    twice = np.zeros(len(fine), dtype=bool)
    twice[1:] = (sig[fine[1:]] == sig[fine[:-1]]) & (held_by[1:] == held_by[:-1])
    keep = np.ones(len(sig), dtype=bool)
    keep[fine[twice]] = False
    sig, entry = sig[keep], entry[keep]
    del order, same, several, fine, twice, keep
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(sig)))
    marked = np.zeros(len(first), dtype=bool)
    marked[np.searchsorted(first, np.flatnonzero(entry < 0), "right") - 1] = True
    hot = marked | (count > most)
    of_hot = entry[np.repeat(hot, count)]
    times = np.bincount(of_hot[of_hot >= 0], minlength=len(key))
    told = np.flatnonzero((times > 0) | (slack < 0))
    for i in range(0, len(told), 100_000):
        part = told[i : i + 100_000]
        yield _rows(1, key[part], band[part], slack[part], times[part])
    cold = np.repeat(~hot & (count > 1), count)
    member = key[entry[cold]] if cold.any() else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(first)), count)[cold]
    left, right, held = [], [], 0
    active, step = np.arange(len(group)), 0
    while len(active):
        step += 1
        active = active[active + step < len(group)]
        active = active[group[active + step] == group[active]]
        a, b = distinct_pairs(member[active], member[active + step])
        left.append(a)
        right.append(b)
        held += len(a)
        if held > 2_000_000:
            a, b = distinct_pairs(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
            if len(a) > 1_000_000:
                yield _rows(0, a, b)
                left, right = [], []
    if left:
        a, b = distinct_pairs(np.concatenate(left), np.concatenate(right))
        for i in range(0, len(a), 100_000):
            yield _rows(0, a[i : i + 100_000], b[i : i + 100_000])


def membership(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_key, n_shingles) per row; equal shingle sets have equal keys, rows without words key 0."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = shingle_sets(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            ], names=["doc_id", "text_hash", "set_key", "n_shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_hash"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, set_key long, n_shingles long")


def parity_bits(s: np.ndarray, share: int = 2) -> bytes:
    """The set's size and a bitmap of at least ``share`` times as many bits, each the parity of the elements on it."""
    width = max(64, 1 << (share * len(s) - 1).bit_length())
    counts = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width)
    return np.int64(len(s)).tobytes() + np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _may_be_similar(mine: bytes, other: bytes, percent: int) -> bool:
    """False only where the bitmaps prove that the sets differ in too many elements."""
    n, m = int(np.frombuffer(mine, np.int64, 1)[0]), int(np.frombuffer(other, np.int64, 1)[0])
    if min(n, m) * 100 < percent * max(n, m):
        return False
    x, y = np.frombuffer(mine, np.uint64, offset=8), np.frombuffer(other, np.uint64, offset=8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (n + m) * (100 - percent)


def are_similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``percent``/100 or more."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _is_similar(mine: bytes, other: bytes, percent: int) -> bool:
    return are_similar(np.frombuffer(mine, dtype=_U), np.frombuffer(other, dtype=_U), percent)


def _fetch(docs: DataFrame, members: DataFrame, wanted: DataFrame, make=np.ndarray.tobytes) -> DataFrame:
    """(key, data): ``make`` of the shingle set of each wanted key, from one row of each."""
    reps = members.where("set_key <> 0").join(wanted.select(F.col("key").alias("set_key")), "set_key", "left_semi")
    ids = stored(reps.groupBy("set_key").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("id"))
                 .groupBy("id").agg(F.count("*").alias("n")), "wanted")
    few = ids.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text_of(docs).alias("text"))
    rows = source.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = shingle_sets(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                pa.array([set_key(s) for s in sets], pa.int64()), pa.array([make(s) for s in sets], pa.binary()),
            ], names=["key", "data"])

    found = rows.select("id", "text").mapInArrow(run, "key long, data binary").where("key <> 0")
    return found.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("data").alias("data"))


def verify(pairs: DataFrame, data: DataFrame, percent: int, test=_is_similar) -> DataFrame:
    """The pairs (a, b) that pass ``test`` on the ``data`` of both keys.

    Each a is dealt out in chunks of its partners, so that a set with very many
    partners is compared in many tasks; within a chunk rows stream past a's set.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(size, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
    partner = dealt.join(data.withColumnRenamed("key", "b"), "b").select("a", "chunk", "b", F.lit(1).alias("kind"), "data")
    own = size.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    own = own.join(data.withColumnRenamed("key", "a"), "a").select("a", "chunk", F.col("a").alias("b"), F.lit(0).alias("kind"), "data")

    def run(batches: Batches) -> Batches:
        current, mine = None, b""
        for batch in batches:
            a_list, b_list = [], []
            for a, chunk, b, kind, other in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if kind == 0:
                    current, mine = (a, chunk), other
                    continue
                if current != (a, chunk):
                    raise ValueError("a pair without its first set")
                if test(mine, other, percent):
                    a_list.append(a)
                    b_list.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_list, pa.int64()), pa.array(b_list, pa.int64())], names=["a", "b"])

    rows = own.unionByName(partner).repartition(shuffle_partitions(pairs.sparkSession), "a", "chunk")
    return rows.sortWithinPartitions("a", "chunk", "kind").select("a", "chunk", "b", "kind", "data").mapInArrow(run, "a long, b long")


def _compare_blocks(needy: DataFrame, bits: DataFrame, percent: int, first_only: bool) -> DataFrame:
    """Pairs (a, b) of one band's needy sets (key, band, c) in different components c whose bitmaps allow similarity.

    Sets are dealt to blocks of about BLOCK by a hash, and each pair of blocks is compared in one task on
    bitmaps; only pairs that pass become rows. With ``first_only`` each set and block pair gives its smallest
    partner only.
    """
    size = needy.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = needy.join(size, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = placed.join(bits, "key").withColumn("other", other).select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "c", "data")

    def compare(rows: list[tuple]) -> tuple[list[int], list[int]]:
        sizes = np.array([int(np.frombuffer(r[3], np.int64, 1)[0]) for r in rows])
        width = min(len(r[3]) - 8 for r in rows) // 8
        grid = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[3], np.uint64, offset=8).reshape(-1, width), axis=0) for r in rows])
        keys, block, c = (np.array([r[k] for r in rows]) for k in (1, 0, 2))
        order = np.argsort(keys)
        keys, block, c, sizes, grid = keys[order], block[order], c[order], sizes[order], grid[order]
        mixed, found = block.min() != block.max(), np.zeros(len(keys), dtype=bool)
        left, right = [], []
        for i in range(len(keys) - 1):
            open_ = (c[i + 1 :] != c[i]) & ~(found[i + 1 :] & first_only)
            if mixed:
                open_ &= block[i + 1 :] != block[i]
            j = np.flatnonzero(open_) + i + 1
            if not len(j):
                continue
            differ = np.bitwise_count(grid[j] ^ grid[i]).sum(axis=1, dtype=np.int64)
            fine = differ * (100 + percent) <= (sizes[j] + sizes[i]) * (100 - percent)
            fine &= np.minimum(sizes[j], sizes[i]) * 100 >= percent * np.maximum(sizes[j], sizes[i])
            j = j[fine]
            found[j] = True
            left += [int(keys[i])] * len(j)
            right += keys[j].tolist()
        return left, right

    def run(batches: Batches) -> Batches:
        current, group = None, []
        for batch in batches:
            for band, low, high, block, key, c, data in zip(*[x.to_pylist() for x in batch.columns]):
                if current != (band, low, high):
                    if group:
                        yield from out(group)
                    current, group = (band, low, high), []
                group.append((block, key, c, data))
        if group:
            yield from out(group)

    def out(group) -> Batches:
        left, right = compare(group)
        for i in range(0, len(left), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(left[i : i + 100_000], pa.int64()), pa.array(right[i : i + 100_000], pa.int64())], names=["a", "b"])

    dealt = rows.repartition(shuffle_partitions(needy.sparkSession), "band", "low", "high").sortWithinPartitions("band", "low", "high")
    return dealt.mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, percent: int, most: int = HOT) -> DataFrame:
    """The membership table with the component's smallest (doc_id, text_hash) as ``first``."""
    spark = session_of(docs)
    bands, parts = Bands(percent), shuffle_partitions(spark)
    members = stored(membership(docs), "members")
    sent = docs.select(text_of(docs).alias("text")).mapInArrow(_emit(bands, parts, most), packets.SCHEMA)
    found = packets.exchange(sent, parts).mapInArrow(lambda batches: _meet(batches, most), "kind int, a long, b long, slack int, hot long")
    found = stored(found, "found")
    pairs = stored(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    needy = stored(
        found.where("kind = 1").groupBy(F.col("a").alias("key"), F.col("b").alias("band"))
        .agg((F.min("slack") - F.sum("hot")).alias("slack")).where("slack < 0").select("key", "band"), "needy")

    def keys_of(*tables: DataFrame) -> DataFrame:
        every = needy.select("key").limit(0)
        for t in tables:
            every = every.unionByName(t.select(F.col("a").alias("key"))).unionByName(t.select(F.col("b").alias("key")))
        return every

    def with_component(df: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
        joined = df.join(of.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left")
        return joined.withColumn(name, F.coalesce(name, column))

    # Most pairs that share a signature share a passage only; bitmaps of a few bytes show it.
    wanted = stored(keys_of(pairs).distinct(), "keys")
    bits = stored(_fetch(docs, members, wanted, parity_bits), "bits")
    pairs = stored(verify(pairs, bits, percent, _may_be_similar), "pairs")
    fine = stored(_fetch(docs, members, stored(needy.select("key").distinct(), "keys"), lambda s: parity_bits(s, 16)), "fine")
    near = stored(_compare_blocks(needy.withColumn("c", F.col("key")), fine, percent, True).distinct(), "near")

    # First each set against its smallest partner, then what is left between components.
    wanted = stored(keys_of(pairs, near).unionByName(needy.select("key")).distinct(), "keys")
    sets = stored(_fetch(docs, members, wanted), "sets")
    star = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(near)
    links = stored(verify(stored(star.distinct(), "star"), sets, percent), "links")
    joined = stored(components(links), "joined")
    open_pairs = with_component(with_component(pairs, joined, "a", "ca"), joined, "b", "cb").where("ca <> cb").select("a", "b")
    cross = _compare_blocks(with_component(needy, joined, "key", "c"), fine, percent, False)
    more = stored(verify(stored(open_pairs.unionByName(cross).distinct(), "open"), sets, percent), "more")
    final = stored(components(links.unionByName(more)), "components")

    linked = final.select(F.col("node").alias("set_key"), "component")
    of_key = members.where("set_key <> 0").join(linked, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    # A NULL doc_id sorts last here, so that it stands for a component only where nothing else does.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    lowest = of_key.groupBy("component").agg(first)
    rows = ("doc_id", "text_hash", "n_shingles", "first")
    alone = members.where("set_key = 0").withColumn("first", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    return of_key.join(lowest, "component").select(*rows).unionByName(alone.select(*rows))


def ngram_jaccard_components(docs: DataFrame, percent: int = 75, most: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (columns doc_id, text; others are ignored).

    Rows link when their sets of distinct 5-word shingles have a Jaccard similarity of
    ``percent``/100 or more; ``component_id`` is the smallest doc_id reachable by links.
    NULL and empty texts have no shingles and link with nothing. Repeated rows each get
    a row. A NULL doc_id takes part, and is a component id only where no other row is
    linked. An empty table gives an empty result.
    """
    return _linked(docs, percent, most).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all their columns.

    The first is the row with the smallest doc_id, then the smallest text hash; of equal rows one
    stays. Rows without words all stay.
    """
    found = _linked(docs, percent)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = found.where((F.col("n_shingles") == 0) | (F.col("first") == mine) | ((F.col("doc_id").isNull()) & F.col("first.none") & (F.col("first.text_hash") == F.col("text_hash"))))
    keep = stored(keep.select(key_of_doc().alias("id"), "text_hash", (F.col("n_shingles") == 0).alias("all")).distinct(), "kept")
    rows = docs.select(whole_row(docs), key_of_doc().alias("id"), F.xxhash64(text_of(docs)).alias("text_hash")).join(keep, ["id", "text_hash"])
    once = F.row_number().over(W.partitionBy("id", "text_hash").orderBy("text_hash"))
    return rows.withColumn("n", once).where(F.col("all") | (F.col("n") == 1)).select("row.*")
