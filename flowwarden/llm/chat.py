"""Chat formatting by incremental black-box rendering.

The template is any function from a list of (role, text) turns to one string. Every prefix of a
conversation is rendered and compared with the render before: what a turn adds is its span, and
a render that does not begin with the one before has rewritten history. The text inside a turn's
span is located by rendering the turn with two probe texts that differ in one character.

A template may declare, as its attribute ``look_back``, that a turn only appends to what was written
before, and that what it appends depends on no more than so many turns before it. Prefixes are then
rendered from their latest turns; without a declaration every prefix is rendered whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Batches, session_of, shuffle_partitions

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
CONTEXT_TURNS = 64
CONTEXT_CHARS = 1 << 20
_CONTROL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[((?:[^\\<\[\]]|\\.)*)\] ((?:[^\\<\[]|\\.)*)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    r"""Backslashes before every character that can begin a control string, so that none occurs in a text."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\<\[\]]", lambda m: "\\" + m.group(), role)


def tagged(turns: Sequence[Turn]) -> str:
    """The standard template: ``<s>[role] text</s>`` and a line end per turn, roles and texts escaped."""
    return "".join(f"<s>[{escape_role(role)}] {escape(text)}</s>\n" for role, text in turns)


tagged.look_back = 0


def read_tagged(formatted: str) -> list[Turn]:
    """The turns of what ``tagged`` has written; an error where it is no such output."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not an output of this template")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def _common_start(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def turn_span(before: str, history: Sequence[Turn], turn: Turn, template: Template) -> tuple[str, int, int, int]:
    """(render, start, text start, text end) of one more turn: start is where it parts from ``before``."""
    now = template([*history, turn])
    start = _common_start(before, now)
    a, b = template([*history, (turn[0], "a")]), template([*history, (turn[0], "b")])
    head = _common_start(a, b)
    tail = _common_start(a[::-1], b[::-1])
    return now, start, head, max(head, len(now) - tail)


def format_chats(conversations: DataFrame, template: Template = tagged) -> DataFrame:
    """One row per turn: (conv_id, position, start, piece, text_start, text_end, role, rewrites, n_turns).

    Turns are taken by ``turn`` (NULL first), ties by role and text; NULL roles and texts are empty. The output
    of a conversation is built by cutting it at ``start`` and appending ``piece``, turn by turn; ``text_start``
    and ``text_end`` place the turn's (escaped) text in it; ``rewrites`` is true where the turn changes what had
    been written before. Rows of one conversation stream through one task in order. Turns are rendered behind all turns before
    them, so work grows with the square of a conversation's length; a template with ``look_back`` holds only a
    bounded history, to which ``CONTEXT_TURNS`` and ``CONTEXT_CHARS`` add nothing but slack. Repeated rows are turns
    of their own, NULL conv_ids form one conversation, an empty table gives an empty result.
    """
    spark = session_of(conversations)
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    look_back = getattr(template, "look_back", None)
    ordered = rows.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Batches) -> Batches:
        started, conv = False, None
        history: list[Turn] = []
        before, shift, position = "", 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for c, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                if not started or c != conv:
                    started, conv, history, before, shift, position = True, c, [], template([]), 0, 0
                now, start, head, end = turn_span(before, history, (role, text), template)
                cut = 0 if position == 0 else start
                values = (c, position, cut + shift, now[cut:], head + shift, end + shift, role, start < len(before) and position > 0)
                for column, value in zip(out, values):
                    column.append(value)
                history.append((role, text))
                before, position = now, position + 1
                if look_back is not None and len(history) > look_back and (len(history) > look_back + CONTEXT_TURNS or len(before) > CONTEXT_CHARS):
                    history = history[len(history) - look_back :]
                    shorter = template(history)
                    shift, before = shift + len(before) - len(shorter), shorter
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = ["conv_id", "position", "start", "piece", "text_start", "text_end", "role", "rewrites"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    return ordered.select("conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, position long, start long, piece string, text_start long, text_end long, role string, rewrites boolean")


def read_back(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites) from ``format_chats`` rows.

    Everything is read from the written pieces of the standard template, in the order in which
    ``format_chats`` yields them; the loss mask is the text spans of ``trained_role``.
    """

    def run(batches: Batches) -> Batches:
        state = None

        def row(s):
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss"], s["masked"].hexdigest(), s["chars"], s["rewrites"])

        for batch in batches:
            done = []
            for conv, position, start, piece, a, b, role, rewrites in zip(*[c.to_pylist() for c in batch.columns]):
                if position == 0:
                    if state is not None:
                        done.append(row(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0, "rewrites": 0}
                for r, t in read_tagged(piece):
                    state["n"] += 1
                    state["turns"].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                    if r == trained_role:
                        masked = unescape(piece[a - start : b - start])
                        state["loss"] += len(masked)
                        state["masked"].update(masked.encode("utf-8", "surrogatepass"))
                state["chars"] = start + len(piece)
                state["rewrites"] += rewrites
            if done:
                yield _digests(done)
        if state is not None:
            yield _digests([row(state)])

    return formatted.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _DIGESTS))


_DIGESTS = (("conv_id", "long"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"),
            ("loss_sha256", "string"), ("formatted_chars", "long"), ("rewrites", "long"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64() if t == "long" else pa.string() for _, t in _DIGESTS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[n for n, _ in _DIGESTS])
