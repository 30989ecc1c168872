"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct words, ordered by rarity in the whole corpus. Lines whose
Jaccard similarity reaches the threshold share a token in their prefixes; length, positional
and parity filters thin the candidates, and the word sets decide. A line goes if an earlier
line (by doc_id, then text hash, then line number; itself kept or not) is similar to it.

Rarity is counted in a table of fixed size, so that it can be broadcast whatever the
vocabulary; any order gives right results, a better one gives fewer candidates. Per line
the likeliest candidate is verified first, the one whose parity bits differ least for its
length, and others only for lines that it does not settle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import packets
from .jaccard_join import CHUNK, are_similar
from .store import Batches, session_of, shuffle_partitions, stored, text_of, whole_row
from .words import first_lines, mix, texts_of, word_hashes

BUCKETS = 1 << 20
FILTER_BITS = 1 << 22
FIRST = 6
FEW_LINES = 1_500_000
_SLICE = 1 << 14
_LINE_BITS, _TEXT_BITS = 28, 35
_U = np.uint64


def _keys(docs: DataFrame) -> list:
    """id and text_key, which tells different texts of one id apart and orders them.

    Texts of NULL id have ids of their own below all others, by a second hash: with 97 bits together they stay
    apart however many there are.
    """
    text_key = F.pmod(F.xxhash64(text_of(docs)), F.lit(1 << _TEXT_BITS))
    own = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64(F.lit("id"), text_of(docs)), 2)
    return [F.coalesce(F.col("doc_id").cast("long"), own).alias("id"), text_key.alias("text_key")]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*_keys(docs), text_of(docs).alias("text"))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> _U(44)).astype(np.int64)


def rarity_table(docs: DataFrame) -> np.ndarray:
    """Occurrences of words by hash bucket over all texts: ``BUCKETS`` numbers, whatever the corpus."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            words, _, _ = word_hashes(texts_of(batch.column(0)))
            total += np.bincount(_bucket(words), minlength=BUCKETS)
        yield packets.batch_of((i, total[i * _SLICE : (i + 1) * _SLICE].astype("<u4").tobytes()) for i in range(BUCKETS // _SLICE))

    def add(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(payload, dtype="<u4").astype(np.int64)
        if sums:
            # Above 2^19 occurrences the order is by hash alone.
            yield packets.batch_of((p, np.minimum(v, (1 << 19) - 1).astype("<u4").tobytes()) for p, v in sums.items())

    parts = min(shuffle_partitions(docs.sparkSession), BUCKETS // _SLICE)
    sent = docs.select(text_of(docs).alias("text")).mapInArrow(count, packets.SCHEMA)
    table = np.zeros(BUCKETS, dtype=np.uint32)
    for part, payload in packets.exchange(sent, parts).mapInArrow(add, packets.SCHEMA).collect():
        table[part * _SLICE : (part + 1) * _SLICE] = np.frombuffer(payload, dtype="<u4")
    return table


def _rank(words: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The place of each word in the order of rarity: its bucket's count, then its hash."""
    return (rarity[_bucket(words)].astype(_U) << _U(45)) | (words >> _U(19))


def _order(line: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorts by (line, rank) for lines that are already in order."""
    if not len(line) or line[-1] - line[0] >= 1 << 22:
        return np.lexsort((rank, line))
    key = ((line - line[0]).astype(_U) << _U(42)) | (rank >> _U(22))
    order = np.argsort(key)
    key = key[order]
    while len(swap := np.flatnonzero((key[1:] == key[:-1]) & (rank[order[1:]] < rank[order[:-1]]))):
        swap = swap[np.concatenate([[True], np.diff(swap) > 1])]
        order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()
    return order


class Lines:
    """The distinct word sets of the lines of a batch, tokens in order of rarity (of hash without a table).

    With ``token_bits`` only lines that hold one of those tokens are kept; with ``wanted`` only those of these
    batch-wide line numbers.
    """

    def __init__(self, texts: list[bytes], rarity: np.ndarray | None = None, token_bits=None, wanted: np.ndarray | None = None):
        words, _, line = word_hashes(texts)
        if wanted is not None:
            keep = np.isin(line, wanted)
            words, line = words[keep], line[keep]
        rank = words if rarity is None else _rank(words, rarity)
        if token_bits is not None:
            hit = np.zeros(int(line[-1]) + 1 if len(line) else 0, dtype=bool)
            hit[line[token_bits[_bits(rank)]]] = True
            keep = hit[line]
            words, line, rank = words[keep], line[keep], rank[keep]
        order = _order(line, rank)
        line, rank, words = line[order], rank[order], words[order]
        new = np.ones(len(line), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (rank[1:] != rank[:-1])
        self.words, self.rank = words[new], rank[new]
        line = line[new]
        self.first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
        self.size = np.diff(np.append(self.first, len(line)))
        self.line = line[self.first]  # batch-wide line number of each line that has words
        starts = first_lines(texts)
        self.doc = np.searchsorted(starts, self.line, "right") - 1
        self.number = self.line - starts[self.doc]


def _bits(values: np.ndarray) -> np.ndarray:
    return (mix(values) % _U(FILTER_BITS)).astype(np.int64)


def _pair_bits(i: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _bits(mix(i.astype(_U)) ^ m.astype(_U))


def _bits_of_pairs(batches: Batches) -> Batches:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_pair_bits(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], names=["bit"])


def bit_filter(parts: DataFrame) -> np.ndarray:
    """The union of bit positions ``bit`` as a bitmap of ``FILTER_BITS`` bits."""
    out = np.zeros(FILTER_BITS, dtype=bool)
    for row in parts.select("bit").distinct().toLocalIterator():
        out[row[0]] = True
    return out


_ENTRY = ("u4", "u1", "u4", "u1", "u2", "u2", "u1", "u8", "u8", "i8", "i8")
#: 128 parity bits tell hardly any sets of more words than that apart: entries of lines from ``LONG`` words carry so many
#: further 64 bits. In the last pass, where all candidates count, those of all lines carry more of them.
LONG, _LONG_WIDE, _WIDE = 112, 5, 8
_OCCURRENCE = ("u8", "i8", "i8", "u1")


def _size_class(size: np.ndarray, percent: int) -> np.ndarray:
    """Never falls with the size; sizes that similar lines can have lie in one class or in neighbouring ones."""
    return (np.log(size) / np.log(100 / min(percent, 99))).astype(_U)


def _class_bits(token: np.ndarray, size_class: np.ndarray) -> np.ndarray:
    return _bits(mix(token) + size_class)


def _emit(rarity, parts: int, percent: int, token_bits=None, class_bits=None, line_bits=None):
    """Per part packets: prefix tokens (first byte 0; 2 with further parity bits) and line occurrences (first byte 1).

    With the bit filters only tokens of the lines they were made of, in lines whose size suits one of them.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = Lines(texts_of(batch.column(2)), rarity.value, token_bits and token_bits.value)
            if not len(found.first):
                continue
            at_id, at_mark = ids[found.doc], (keys[found.doc] << _LINE_BITS) | found.number
            content = mix(np.add.reduceat(mix(found.words), found.first) + found.size.astype(_U))
            # Equal lines of a batch: the earliest represents them, the others are decided here.
            order = np.lexsort((at_mark, at_id, content))
            lead = np.ones(len(order), dtype=bool)
            lead[1:] = content[order[1:]] != content[order[:-1]]
            earliest = np.zeros(len(order), dtype=bool)
            earliest[order[lead]] = True
            rows = []
            if token_bits is None:
                occurrence = [content, at_id, at_mark, (~earliest).astype(np.uint8)]
                for p, columns in packets.split_rows((content % _U(parts)).astype(np.int64), occurrence, parts):
                    rows.append((p, b"\1" + packets.pack(columns)))
            size = found.size
            prefix = size - -(-size * percent // 100) + 1
            # 128 parity bits of the set: the more of them differ, the more the sets do.
            bit, upper = _U(1) << (found.words & _U(63)), (found.words & _U(64)) > 0
            parity = [np.bitwise_xor.reduceat(np.where(upper == half, bit, _U(0)), found.first) for half in (False, True)]
            long = size >= (LONG if token_bits is None else 0)
            # Sets of one or two words are similar only where they are equal.
            use = earliest & (size >= 3)
            where = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(where)) - found.first[where]
            keep = use[where] & (pos < prefix[where])
            wanted = np.ones(len(size), dtype=bool)
            if token_bits is not None:
                wanted = line_bits.value[_pair_bits(at_id, at_mark)]
                keep &= class_bits.value[_class_bits(found.rank, _size_class(size, percent)[where])]
            for form, kept in ((b"\0", keep & ~long[where]), (b"\2", keep & long[where])):
                if not kept.any():
                    continue
                at, place, token = where[kept], pos[kept], mix(found.rank[kept])
                rest = token // _U(parts)
                columns = [
                    (rest >> _U(8)).astype(np.uint32), (rest & _U(0xFF)).astype(np.uint8),
                    (content[at] >> _U(32)).astype(np.uint32), (content[at] & _U(0xFF)).astype(np.uint8),
                    np.minimum(size[at], 0xFFFF).astype(np.uint16), np.minimum(place, 0xFFFF).astype(np.uint16),
                    wanted[at].astype(np.uint8), parity[0][at], parity[1][at], at_id[at], at_mark[at],
                ]
                if form == b"\2":
                    columns += _further_parity(found, long, _LONG_WIDE if token_bits is None else _WIDE, at)
                for p, dealt in packets.split_rows((token % _U(parts)).astype(np.int64), columns, parts):
                    rows.append((p, form + packets.pack(dealt)))
            if rows:
                yield packets.batch_of(rows)

    return run


def _further_parity(found: Lines, long: np.ndarray, wide: int, at: np.ndarray) -> list[np.ndarray]:
    """``wide`` times 64 parity bits, by other bits of the words' hashes, of the lines ``at``, all of which are ``long``."""
    words = found.words[np.repeat(long, found.size)]
    first = np.concatenate([[0], np.cumsum(found.size[long])[:-1]])
    bit, slot = _U(1) << ((words >> _U(7)) & _U(63)), (words >> _U(13)) % _U(wide)
    place = np.cumsum(long)[at] - 1
    return [np.bitwise_xor.reduceat(np.where(slot == _U(k), bit, _U(0)), first)[place] for k in range(wide)]


def _likeliest_few(y, x, far, few: int | None):
    """Distinct (y, x), per y the ``few`` x that differ least (ties: the earliest), their ``far`` and whether y had more."""
    order = np.lexsort((x[1], x[0], far, y[1], y[0]))
    y, x, far = [c[order] for c in y], [c[order] for c in x], far[order]
    new_y = np.ones(len(order), dtype=bool)
    new_y[1:] = (y[0][1:] != y[0][:-1]) | (y[1][1:] != y[1][:-1])
    new = new_y.copy()
    # A pair has one distance, whatever token it was met at, so its repeats lie together.
    new[1:] |= (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
    y, x, far, new_y = [c[new] for c in y], [c[new] for c in x], far[new], new_y[new]
    first = np.flatnonzero(new_y)
    count = np.diff(np.append(first, len(new_y)))
    rank = np.arange(len(new_y)) - np.repeat(first, count)
    more = np.repeat(count > (few or 1 << 60), count)
    keep = rank < (few or 1 << 60)
    return [c[keep] for c in y], [c[keep] for c in x], far[keep], more[keep]


_FOUND = pa.schema([("kind", pa.int32()), *[(n, pa.int64()) for n in ("id", "mark", "id2", "mark2")], ("far", pa.int32()), ("more", pa.bool_())])
_FOUND_SQL = "kind int, id long, mark long, id2 long, mark2 long, far int, more boolean"


def _found(kind: int, y, x, far, more) -> Batches:
    for i in range(0, len(y[0]), 100_000):
        s = slice(i, i + 100_000)
        n = len(y[0][s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *[pa.array(c[s]) for c in (*y, *x)], pa.array(far[s]), pa.array(more[s])], schema=_FOUND)


def _meet(percent: int, few: int | None, wide: int):
    """Decided lines (kind 0: equal to an earlier one) and candidate pairs (kind 1) of the packets of a task."""
    forms = (_ENTRY, _OCCURRENCE, _ENTRY + ("u8",) * wide)

    def run(batches: Batches) -> Batches:
        packed: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for payload in batch.column(1).to_pylist():
                packed[payload[0]].append(packets.unpack(payload[1:], forms[payload[0]]))
        short, lines, long = packed
        if lines:
            content, i, m, late = [np.concatenate(c) for c in zip(*lines)]
            lines.clear()
            order = np.lexsort((m, i, late, content))
            gone = late[order] > 0
            gone[1:] |= content[order[1:]] == content[order[:-1]]
            out = order[gone]
            yield from _found(0, (i[out], m[out]), (i[out], m[out]), np.zeros(len(out), np.int32), np.zeros(len(out), dtype=bool))
        if not short and not long:
            return
        columns = [np.concatenate(c) for c in zip(*short, *[e[: len(_ENTRY)] for e in long])]
        more_bits = [np.concatenate(c) for c in zip(*[e[len(_ENTRY) :] for e in long])]
        hi, lo, content, rest, size, pos, wanted, parity, upper, i, m = columns
        # Where in more_bits an entry's further parity bits lie; -1: it has none.
        further = np.full(len(size), -1, dtype=np.int32)
        if long:
            further[len(size) - len(more_bits[0]) :] = np.arange(len(more_bits[0]), dtype=np.int32)
        short.clear()
        long.clear()
        token = (hi.astype(_U) << _U(8)) | lo
        # One order of lines by (size, content) in all token groups: of a similar pair the first is met in its index prefix.
        line = (size.astype(_U) << _U(48)) | (content.astype(_U) << _U(16)) | (rest.astype(_U) << _U(8)) | (mix(parity ^ mix(upper)) >> _U(56))
        order = np.lexsort((line, token))
        token, line, size, pos, wanted, parity, upper, i, m, further = [c[order] for c in (token, line, size, pos, wanted, parity, upper, i, m, further)]
        # The earliest of equal lines stands for all: the later ones are decided as such, and what is similar to one is to all.
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1]) | (parity[1:] != parity[:-1]) | (upper[1:] != upper[:-1])
        start = np.flatnonzero(new)
        copies = np.diff(np.append(start, len(new)))
        low = np.minimum.reduceat(i, start)
        m = np.minimum.reduceat(np.where(i == np.repeat(low, copies), m, np.iinfo(np.int64).max), start)
        i, wanted = low, np.maximum.reduceat(wanted, start)
        token, size, pos, parity, upper, further = [c[start] for c in (token, size, pos, parity, upper, further)]
        size, pos = size.astype(np.int32), pos.astype(np.int32)
        total = 100 + percent
        index = size - -(-size * 2 * percent // total) + 1
        group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
        # Clipped sizes are alike: every longer line may follow them.
        reach = np.where(size >= 0xFFFF * percent // 100, 0xFFFF, size * 100 // percent)
        stop = np.searchsorted((group << 16) | size, (group << 16) | reach, "right")
        begin = np.flatnonzero((pos < index) | (size >= 0xFFFF))
        count = stop[begin] - begin - 1
        begin, count = begin[count > 0], count[count > 0]
        ends = np.cumsum(count)
        pairs: list[tuple] = []
        held = at = 0
        while at < len(begin):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
            n = count[at:upto]
            s = np.repeat(begin[at:upto], n)
            o = s + 1 + np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            at = upto
            most = (100 - percent) * (size[s] + size[o])
            differ = np.bitwise_count(parity[s] ^ parity[o]).astype(np.int32)
            fine = differ * total <= most
            s, o, differ, most = s[fine], o[fine], differ[fine], most[fine]
            differ += np.bitwise_count(upper[s] ^ upper[o])
            fine = differ * total <= most
            s, o, differ, most = s[fine], o[fine], differ[fine], most[fine]
            both = np.flatnonzero((further[s] >= 0) & (further[o] >= 0))
            if len(both):
                one, two = further[s[both]], further[o[both]]
                differ[both] = np.maximum(differ[both], sum(np.bitwise_count(c[one] ^ c[two]).astype(np.int32) for c in more_bits))
                fine = differ * total <= most
                s, o, differ = s[fine], o[fine], differ[fine]
            a, b, p, q = size[s], size[o], pos[s], pos[o]
            fine = np.minimum(p, q) + np.minimum(a - p, b - q) >= -(-percent * (a + b) // total)
            fine |= b >= 0xFFFF
            fine &= (i[s] != i[o]) | (m[s] != m[o])
            s, o, differ = s[fine], o[fine], differ[fine]
            later = (i[s] > i[o]) | ((i[s] == i[o]) & (m[s] > m[o]))
            y, x = np.where(later, s, o), np.where(later, o, s)
            use = wanted[y] > 0
            y, x, differ = y[use], x[use], differ[use]
            if len(y):
                far = (differ.astype(np.int64) * 100_000 // (size[y] + size[x])).astype(np.int32)
                pairs.append(((i[y], m[y]), (i[x], m[x]), far, np.zeros(len(y), dtype=bool)))
                held += len(y)
            if held > 3_000_000:
                pairs = [_merged(pairs, few)]
                held = len(pairs[0][3])
                if few is None and held > 1_500_000:
                    yield from _found(1, *pairs.pop())
                    held = 0
        if pairs:
            yield from _found(1, *_merged(pairs, few))

    return run


def _merged(pairs, few: int | None):
    y = [np.concatenate([p[0][k] for p in pairs]) for k in (0, 1)]
    x = [np.concatenate([p[1][k] for p in pairs]) for k in (0, 1)]
    far, marked = (np.concatenate([p[k] for p in pairs]) for k in (2, 3))
    told = np.unique(np.stack([y[0][marked], y[1][marked]], axis=1), axis=0) if marked.any() else None
    y, x, far, more = _likeliest_few(y, x, far, few)
    if told is not None:
        known = set(map(tuple, told.tolist()))
        more |= np.fromiter(((p, q) in known for p, q in zip(y[0].tolist(), y[1].tolist())), dtype=bool, count=len(more))
    return y, x, far, more


def _packed(words: np.ndarray) -> bytes:
    """Sorted word hashes as five bytes each: enough to tell the words of two lines apart."""
    short = np.unique(words >> _U(24)).astype("<u8")
    return short.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _line_words(rows: DataFrame, wanted: DataFrame, form=_packed) -> DataFrame:
    """(tag, data) per wanted (id, mark, tag): ``form`` of the line's sorted word hashes."""
    per_text = stored(
        wanted.groupBy("id", F.shiftright("mark", _LINE_BITS).alias("text_key"))
        .agg(F.collect_list(F.struct(F.col("mark").bitwiseAND((1 << _LINE_BITS) - 1).alias("number"), "tag")).alias("lines")), "wanted")
    few = per_text.agg(F.coalesce(F.sum(F.size("lines") + 2), F.lit(0)).alias("n")).first()["n"] <= FEW_LINES
    joined = rows.join(F.broadcast(per_text) if few else per_text, ["id", "text_key"])
    tag = wanted.schema["tag"].dataType

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts, asked = texts_of(batch.column(0)), batch.column(1)
            lists = asked.flatten()
            owner = np.repeat(np.arange(len(texts)), np.diff(asked.offsets.to_numpy()))
            line = lists.field("number").to_numpy() + first_lines(texts)[owner]
            found = Lines(texts, wanted=line)
            ends = np.append(found.first, len(found.words))
            at = np.minimum(np.searchsorted(found.line, line), max(0, len(found.line) - 1))
            there = np.flatnonzero(found.line[at] == line) if len(found.line) else np.empty(0, np.int64)
            data = [form(found.words[ends[k] : ends[k + 1]]) for k in at[there]]
            yield pa.RecordBatch.from_arrays([lists.field("tag").take(pa.array(there)), pa.array(data, pa.binary())], names=["tag", "data"])

    return joined.select("text", "lines").mapInArrow(run, f"tag {tag.simpleString()}, data binary")


def _similar(rows: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """(id, mark) of the later lines of those candidate pairs (id, mark, id2, mark2) that are similar.

    The word sets of both lines are sent to the earlier line's task; earlier lines with very many
    partners are dealt out in chunks.
    """
    pairs = stored(candidates.select("id", "mark", "id2", "mark2").distinct(), "line_pairs")
    size = pairs.groupBy("id2", "mark2").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("id", "mark"), F.col("chunks")).cast("int").alias("chunk")
    partner = pairs.join(size, ["id2", "mark2"]).select("id", "mark", F.struct("id2", "mark2", chunk, F.lit(1).alias("kind"), "id", "mark").alias("tag"))
    own = size.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        F.col("id2").alias("id"), F.col("mark2").alias("mark"),
        F.struct("id2", "mark2", "chunk", F.lit(0).alias("kind"), F.col("id2").alias("id"), F.col("mark2").alias("mark")).alias("tag"))
    words = _line_words(rows, partner.unionByName(own)).select("tag.*", "data")
    dealt = words.repartition(shuffle_partitions(rows.sparkSession), "id2", "mark2", "chunk").sortWithinPartitions("id2", "mark2", "chunk", "kind")

    def run(batches: Batches) -> Batches:
        current, mine = None, np.empty(0, _U)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            id2, mark2, chunk, kind, i, m, data = (batch.column(k).to_pylist() for k in range(7))
            for k in range(len(kind)):
                if kind[k] == 0:
                    current, mine = (id2[k], mark2[k], chunk[k]), _unpacked(data[k])
                elif current != (id2[k], mark2[k], chunk[k]):
                    raise ValueError("a pair without its first line")
                elif are_similar(mine, _unpacked(data[k]), percent):
                    found[0].append(i[k])
                    found[1].append(m[k])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "mark"])

    return dealt.mapInArrow(run, "id long, mark long").distinct()


def _bits_of_lines(lines: DataFrame, rows: DataFrame, rarity, percent: int):
    """Bit filters of the given lines: their prefix tokens, these with the classes of the sizes similar to theirs, their positions."""
    positions = lines.select("id", "mark")

    def of_tokens(batches: Batches) -> Batches:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                words = np.frombuffer(data, dtype=_U)
                rank = np.sort(_rank(words, rarity.value))
                n = len(rank)
                prefix = rank[: n - -(-n * percent // 100) + 1]
                low, high = _size_class(np.array([-(-n * percent // 100), n * 100 // percent]), percent).tolist()
                bits = [_bits(prefix), *[_class_bits(prefix, _U(c)) for c in range(low, high + 1)]]
                kind = np.repeat([0, 1], [len(prefix), len(prefix) * (len(bits) - 1)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate(bits))], names=["kind", "bit"])

    words = stored(_line_words(rows, positions.withColumn("tag", F.lit(0)), np.ndarray.tobytes), "line_words")
    bits = stored(words.select("data").mapInArrow(of_tokens, "kind long, bit long").distinct(), "token_bits")
    return (*[bit_filter(bits.where(F.col("kind") == kind)) for kind in (0, 1)],
            bit_filter(positions.mapInArrow(_bits_of_pairs, "bit long")))


def removed_lines(docs: DataFrame, percent: int = 75, first: int = FIRST) -> DataFrame:
    """(id, text_key, numbers): per text the numbers of the lines that go; texts that keep all lines are absent."""
    spark = session_of(docs)
    parts, rows = shuffle_partitions(spark), _identified(docs)
    rarity = spark.sparkContext.broadcast(rarity_table(docs))
    sent = rows.mapInArrow(_emit(rarity, parts, percent), packets.SCHEMA)
    found = stored(packets.exchange(sent, parts).mapInArrow(_meet(percent, first, _LONG_WIDE), _FOUND_SQL), "found")
    equal = found.where("kind = 0").select("id", "mark")
    # Lines that equal an earlier one have no candidates; of the others each is held against its likeliest one.
    mine, x = ["id", "mark"], F.struct("far", "id2", "mark2")
    candidates = stored(
        found.where("kind = 1").groupBy(*mine)
        .agg(F.array_sort(F.collect_set(x)).alias("x"), F.max("more").alias("more")), "candidates")
    similar = stored(_similar(rows, candidates.select(*mine, F.col("x")[0].alias("x")).select(*mine, "x.id2", "x.mark2"), percent), "similar")
    gone = equal.unionByName(similar)
    # A line has at most one candidate per prefix token and task here: few, whatever its group's size.
    open_lines = (F.size("x") > 1) | F.col("more")
    unsettled = stored(candidates.where(open_lines).join(similar, mine, "left_anti"), "unsettled")
    if unsettled.limit(1).count():
        rest = unsettled.select(*mine, F.explode(F.slice("x", 2, F.size("x"))).alias("x")).select(*mine, "x.id2", "x.mark2")
        others = stored(_similar(rows, rest, percent), "similar")
        gone = gone.unionByName(others)
        unsettled = stored(unsettled.where("more").select(*mine).join(others, mine, "left_anti"), "unsettled")
    if unsettled.limit(1).count():
        filters = [spark.sparkContext.broadcast(b) for b in _bits_of_lines(unsettled, rows, rarity, percent)]
        again = rows.mapInArrow(_emit(rarity, parts, percent, *filters), packets.SCHEMA)
        every = packets.exchange(again, parts).mapInArrow(_meet(percent, None, _WIDE), _FOUND_SQL)
        gone = gone.unionByName(_similar(rows, every.join(unsettled, mine, "left_semi"), percent))
    numbers = F.collect_set(F.col("mark").bitwiseAND((1 << _LINE_BITS) - 1).cast("int")).alias("numbers")
    return gone.distinct().groupBy("id", F.shiftright("mark", _LINE_BITS).alias("text_key")).agg(numbers)


def dedup_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with the column ``text`` less its repeated lines, plus ``n_lines`` and ``n_removed``.

    A line is what stands between ``\\n``; its tokens are its distinct words, A-Z as a-z. A line goes if an
    earlier line of the corpus has a Jaccard similarity of ``percent``/100 or more to it. Lines without words
    always stay. Texts are ordered by doc_id (NULL first), then by a hash of the text; rows equal in doc_id and
    text are one document and keep the same lines. NULL text stays NULL with no lines. Other columns stay as
    they are, whatever their names (``n_lines`` and ``n_removed`` are replaced). An empty table gives an empty
    result.
    """
    spark = session_of(docs)
    gone = stored(removed_lines(docs, percent), "gone")
    keyed = docs.select(whole_row(docs), *_keys(docs))
    # Texts that keep all lines need not travel: a bitmap of fixed size tells most of them.
    changed = spark.sparkContext.broadcast(bit_filter(gone.select("id", "text_key").mapInArrow(_bits_of_pairs, "bit long")))

    @F.pandas_udf("boolean")
    def maybe_changed(i: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(changed.value[_pair_bits(i.to_numpy(np.int64), k.to_numpy(np.int64))])

    maybe = keyed.withColumn("maybe", maybe_changed("id", "text_key"))
    still = maybe.where(~F.col("maybe")).withColumn("numbers", F.lit(None).cast("array<int>"))
    joined = maybe.where("maybe").join(gone, ["id", "text_key"], "left").unionByName(still)
    text = F.col("row.text")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("numbers", i)), "\n")
    cleaned = F.when(F.col("numbers").isNull(), text).otherwise(kept).alias("text")
    return joined.select(
        *[cleaned if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_removed"))
