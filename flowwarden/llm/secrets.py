"""Secret scans with inferred grammars.

Credentials found by fixed patterns are the labelled examples. Per kind, a prefix tree of their
character classes is folded into a probabilistic automaton by merging states whose outgoing
frequencies are statistically compatible (ALERGIA). Every token of every text is then scored by
how much likelier an automaton makes it than ordinary text does.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import Batches, session_of, stored, text_of

KINDS = ("assign", "access", "hex")
EXAMPLES = 1_000
THRESHOLD = 0.8
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run that is too short as a whole has no part that is long enough: bounds inside the pattern change nothing.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9=]")
# For the RE2 engine, to pass over texts that hold no base span, or neither that nor a token.
_BASE = r"""(?i:password|passwd|secret|token|apikey|api_key)["']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
_ANY = _BASE + r"|[A-Za-z0-9+/_.=-]{6}"
# Tokens shorter than this need a higher score, as a mean over few characters varies more.
_STEADY = 16
_KEPT = 1 << 16
_CLASS = {chr(c): k for k, chars in {
    "U": range(65, 91), "l": range(103, 123), "x": range(97, 103), "d": range(48, 58)}.items() for c in chars}
_SIZE = {"U": 26, "l": 20, "x": 6, "d": 10}
_BEFORE = " Ulxd"
_BEFORE_CODE = np.array([_BEFORE.index(_CLASS.get(chr(c), " ")) for c in range(128)] + [0] * 128, dtype=np.int64)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0, m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), 1, m.group()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m.group()) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(out, key=lambda x: (x[0], x[2]))]


def classes(value: str) -> str:
    return "".join(_CLASS.get(c, c) for c in value)


@dataclass
class Automaton:
    """States with frequencies: how often each symbol leaves a state, where to, and how often strings end there."""

    next: list[dict[str, int]]
    count: list[dict[str, int]]
    final: list[int]

    def __post_init__(self) -> None:
        # Per state: log probability of a character and the state after it; log probability of the end.
        self._steps: list[dict[str, tuple[float, int]]] = [{} for _ in self.final]
        self._ends: list[float] = []
        self._unseen = 0.0

    def _prepare(self, unseen: float) -> None:
        self._steps, self._ends, self._unseen = [{} for _ in self.final], [], unseen
        for state, out in enumerate(self.count):
            n = sum(out.values()) + self.final[state]
            self._ends.append(math.log(max(self.final[state] / n if n else 0, unseen)))

    def _step(self, state: int, c: str) -> tuple[float, int]:
        out, k = self.count[state], _CLASS.get(c, c)
        n = sum(out.values()) + self.final[state]
        found = math.log(max(out.get(k, 0) / n if n else 0, self._unseen) / _SIZE.get(k, 1)), self.next[state].get(k, state)
        self._steps[state][c] = found
        return found

    def log_likelihood(self, value: str, unseen: float = 1e-5) -> float:
        """Log probability of the characters of ``value`` and of ending after them."""
        if unseen != self._unseen:
            self._prepare(unseen)
        state, total, steps = 0, 0.0, self._steps
        for c in value:
            x, state = steps[state].get(c) or self._step(state, c)
            total += x
        return total + self._ends[state]


def infer(values: list[str], alpha: float = 0.05) -> Automaton:
    """ALERGIA: fold the prefix tree of the values' character classes, merging compatible states in breadth-first order."""
    nxt: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    final = [0]
    for word, times in sorted(Counter(map(classes, values)).items()):
        s = 0
        for c in word:
            count[s][c] = count[s].get(c, 0) + times
            if c not in nxt[s]:
                nxt[s][c] = len(nxt)
                nxt.append({})
                count.append({})
                final.append(0)
            s = nxt[s][c]
        final[s] += times
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def total(s: int) -> int:
        return sum(count[s].values()) + final[s]

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            n, m = total(p), total(q)
            if differ(final[p], n, final[q], m):
                return False
            for c in count[p].keys() | count[q].keys():
                if differ(count[p].get(c, 0), n, count[q].get(c, 0), m):
                    return False
                if c in nxt[p] and c in nxt[q]:
                    stack.append((nxt[p][c], nxt[q][c]))
        return True

    def fold(into: int, tree: int) -> None:
        stack = [(into, tree)]
        while stack:
            p, q = stack.pop()
            final[p] += final[q]
            for c, n in count[q].items():
                count[p][c] = count[p].get(c, 0) + n
                if c in nxt[p]:
                    stack.append((nxt[p][c], nxt[q][c]))
                else:
                    nxt[p][c] = nxt[q][c]

    kept = [0]
    fringe = [(0, c) for c in sorted(nxt[0])]
    while fringe:
        fringe.sort(key=lambda e: -total(nxt[e[0]][e[1]]))
        parent, c = fringe.pop(0)
        state = nxt[parent][c]
        if state in kept:
            continue
        for other in kept:
            if compatible(other, state):
                nxt[parent][c] = other
                fold(other, state)
                break
        else:
            kept.append(state)
        fringe = [(s, x) for s in kept for x in sorted(nxt[s]) if nxt[s][x] not in kept]
    number = {s: i for i, s in enumerate(kept)}
    return Automaton([{c: number[t] for c, t in nxt[s].items()} for s in kept], [dict(count[s]) for s in kept], [final[s] for s in kept])


@dataclass
class Grammars:
    automata: dict[str, Automaton]
    background: dict[tuple[str, str], float]
    unseen: float

    def __post_init__(self) -> None:
        self._scores: dict[str, float] = {}

    def score(self, token: str) -> float:
        """The largest log-likelihood ratio per character of any automaton against ordinary text.

        Below 16 characters it shrinks with the root of the length, as the error of a mean grows.
        """
        found = self._scores.get(token)
        if found is None:
            found = self._score(token)
            if len(token) <= 64:
                if len(self._scores) >= _KEPT:
                    self._scores.clear()
                self._scores[token] = found
        return found

    def _score(self, token: str) -> float:
        plain, before = 0.0, " "
        for c in token:
            plain += self.background.get((before, c), self.unseen)
            before = _CLASS.get(c, " ")
        best = max((a.log_likelihood(token) - plain for a in self.automata.values()), default=-math.inf) / max(1, len(token))
        return best * min(1.0, math.sqrt(len(token) / _STEADY)) if best > 0 else best

    def spans(self, text: str, threshold: float, based: bool = True) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and tokens clear of them that score ``threshold`` or more, as kind ``inferred``.

        ``based`` is false if the text is known to have no base span.
        """
        base = [(a, b, k) for a, b, k, _ in base_spans(text)] if based else []
        found, at, end = [], 0, -1
        for m in _TOKEN.finditer(text):
            while at < len(base) and base[at][0] < m.end():
                end = max(end, base[at][1])
                at += 1
            if m.start() >= end and self.score(m.group()) >= threshold:
                found.append((m.start(), m.end(), "inferred"))
        return base, found


def letter_pairs(texts: list[str], based: list[bool]) -> np.ndarray:
    """How often each ASCII character (of 128) follows each class of ``_BEFORE`` outside base spans; flat, by class.

    ``based`` is false for texts that are known to have no base span.
    """
    parts = []
    for text, some in zip(texts, based):
        at = 0
        for start, end, *_ in base_spans(text) if some else ():
            if start > at:
                parts.append(text[at:start])
            at = max(at, end)
        parts.append(text[at:])
    # What parts the pieces is not ASCII: not counted itself, of no class.
    codes = np.frombuffer("\x80".join(["", *parts]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    now, before = codes[1:], _BEFORE_CODE[codes[:-1]]
    plain = now < 128
    return np.bincount(before[plain] * 128 + now[plain], minlength=len(_BEFORE) * 128)


def learn(docs: DataFrame, examples: int = EXAMPLES) -> Grammars:
    """Grammars from at most ``examples`` distinct base values of each kind (those with the smallest hashes).

    Ordinary text is how often each character follows each class of character outside base spans, over all documents.
    """
    session_of(docs)

    def extract(batches: Batches) -> Batches:
        for batch in batches:
            kinds, values = [], []
            for text in batch.filter(pc.match_substring_regex(batch.column(0), _BASE)).column(0).to_pylist():
                for _, _, kind, value in base_spans(text):
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    rows = docs.select(text_of(docs).alias("text"))
    values = stored(rows.mapInArrow(extract, "kind string, value string").where(F.length("value") <= 512).distinct(), "values")
    automata = {}
    for kind in KINDS:
        some = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples).collect()
        if some:
            automata[kind] = infer([r["value"] for r in some])

    def letters(batches: Batches) -> Batches:
        total = np.zeros(len(_BEFORE) * 128, dtype=np.int64)
        for batch in batches:
            total += letter_pairs(batch.column(0).to_pylist(), pc.match_substring_regex(batch.column(0), _BASE).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.array([_BEFORE[i] for i in at // 128], pa.string()), pa.array([chr(i) for i in at % 128], pa.string()), pa.array(total[at])], names=["p", "c", "n"])

    counts = rows.mapInArrow(letters, "p string, c string, n long").groupBy("p", "c").agg(F.sum("n").alias("n")).collect()
    total = Counter()
    for r in counts:
        total[r["p"]] += r["n"]
    background = {(r["p"], r["c"]): math.log((r["n"] + 1) / (total[r["p"]] + 128)) for r in counts}
    return Grammars(automata, background, math.log(1 / (sum(total.values()) + 128)))


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs`` (doc_id, text; NULL: empty).

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind as listed with ``inferred``
    last. ``base_sha256`` digests the base spans alone. Texts without spans have an empty list. Repeated rows and
    NULL ids get rows of their own; an empty table gives an empty result.
    """
    grammars = session_of(docs).sparkContext.broadcast(learn(docs))
    order = {k: i for i, k in enumerate((*KINDS, "inferred"))}
    none = hashlib.sha256(b"").hexdigest()

    def text(spans) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n = batch.num_rows
            columns: list[list] = [[0] * n, [0] * n, [0] * n, [none] * n, [""] * n]
            maybe = pc.indices_nonzero(pc.match_substring_regex(batch.column(1), _ANY))
            some = batch.column(1).take(maybe)
            for i, t, based in zip(maybe.to_pylist(), some.to_pylist(), pc.match_substring_regex(some, _BASE).to_pylist()):
                base, more = grammars.value.spans(t, threshold, based)
                for k, kind in enumerate(KINDS):
                    columns[k][i] = sum(x[2] == kind for x in base)
                if base:
                    columns[3][i] = hashlib.sha256(text(base).encode()).hexdigest()
                columns[4][i] = text(sorted([*base, *more], key=lambda x: (x[0], order[x[2]])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3]), pa.array(columns[4])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
