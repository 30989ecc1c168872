"""Token counts by the whole-token shortcut.

Before the job it is proved which strings of the vocabulary encode, alone, as one token. A text is
then split into pre-tokens as its tokenizer splits it; a pre-token that equals a proved string
counts one, the others are merged by the tokenizer's own model, each different one once per worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .packing import tokenizer_path
from .store import Batches, session_of, text_of

LIMIT = 512
#: Merged pre-tokens kept per worker and their longest length: memory only, results do not depend on them.
_KEPT, _KEPT_CHARS = 400_000, 64
_LONG = 1 << 20
_SPACE = "\u2581"


def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _piece_merges(path: str) -> Callable[[str], int]:
    """Tokens of one segment, which begins with the space mark that the library puts before every text."""
    pieces = _pieces(path)
    return lambda segment: len(pieces.encode(segment[1:].replace(_SPACE, " ")))


def _separable(path: str) -> bool:
    """True if no merge of this sentencepiece file can cross the place before a run of space marks.

    That holds for a BPE file (whole numbers as scores, the ranks of the merges) in which no piece has a space
    mark behind another character, and whose texts get a leading mark and keep their spaces.
    """
    pieces = _pieces(path)
    ordinary = [i for i in range(len(pieces)) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))]
    texts = [pieces.id_to_piece(i) for i in ordinary]
    return (
        all(pieces.get_score(i).is_integer() for i in ordinary)
        and not any(_SPACE in t.lstrip(_SPACE) for t in texts)
        and pieces.normalize("a  a") == f"{_SPACE}a{_SPACE}{_SPACE}a"
    )


def prove_whole_tokens(path: str) -> frozenset[str] | None:
    """The vocabulary strings that, as a pre-token, are one token, in the form in which pre-tokens are compared.

    Every string goes through the merges once. None where the shortcut cannot be proved for this file: then
    texts are counted by the library itself.
    """
    if path.endswith(".model"):
        if not _separable(path):
            return None
        pieces, merged = _pieces(path), _piece_merges(path)
        strings = [s for s in map(pieces.id_to_piece, range(len(pieces))) if s.startswith(_SPACE)]
        return frozenset(s for s in strings if merged(s) == 1)
    tokenizer = _library(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added, word_end = spec.get("added_tokens") or [], spec["model"].get("end_of_word_suffix") or ""
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    special = {t["content"] for t in added}
    whole = {s.removesuffix(word_end) for s in tokenizer.get_vocab(with_added_tokens=False) if s not in special}
    return frozenset(s for s in whole if len(tokenizer.model.tokenize(s)) == 1)


class _Merged(dict):
    """Token counts by pre-token: 1 for proved strings, merged and remembered for others."""

    def __init__(self, whole: Iterable[str], merge: Callable[[str], int]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge = len(self), merge
        self.rest: dict[str, int] = {}

    def __missing__(self, pre_token: str) -> int:
        n = self.rest.get(pre_token)
        if n is None:
            n = self.merge(pre_token)
            if len(pre_token) <= _KEPT_CHARS:
                if len(self.rest) >= _KEPT:
                    self.rest.clear()
                self.rest[pre_token] = n
        return n

    def total(self, pre_tokens: Iterable[str]) -> int:
        return sum(map(self.__getitem__, pre_tokens))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


# One pattern, once for texts of ASCII only and once for all; the spaces are those of the Unicode property White_Space.
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
_ASCII_FORM = _PRE_TOKEN.format(L="[A-Za-z]", N="[0-9]", s=r"\t-\r ", l="A-Za-z", n="0-9")
_ANY_FORM = _PRE_TOKEN.format(
    L=r"\p{L}", N=r"\p{N}", s=r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", l=r"\p{L}", n=r"\p{N}")


class _ByteLevel:
    """Pre-tokens of the byte-level splitter as plain text.

    The pattern is run by Python; a text with a character that the library's splitter puts into another class than
    Python does (their Unicode tables may differ) is split by the library. Each character is asked for once per worker.
    """

    def __init__(self, tokenizer):
        import regex

        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.ascii, self.any = re.compile(_ASCII_FORM), regex.compile(_ANY_FORM)
        self.agreed: set[str] = set(map(chr, range(128)))
        self.differing: set[str] = set()
        letters = _byte_letters()
        self.to_letters = dict(enumerate(letters))
        self.to_bytes = {ord(c): b for b, c in enumerate(letters)}

    def letters_of(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.to_letters)

    def text_of(self, letters: str) -> str | None:
        try:
            return letters.translate(self.to_bytes).encode("latin-1").decode()
        except UnicodeDecodeError:
            return None

    def _same_class(self, c: str) -> bool:
        return all(
            [self.text_of(t) for t, _ in self.split(probe)] == self.any.findall(probe)
            for probe in (f"a{c}a", f"1{c}1", f"!{c}!", f"! {c}", f"!{c}", f"{c}!")
        )

    def __call__(self, text: str) -> Iterable[str]:
        if text.isascii():
            pattern = self.ascii
        else:
            for c in set(text) - self.agreed - self.differing:
                (self.agreed if self._same_class(c) else self.differing).add(c)
            if self.differing and not self.differing.isdisjoint(text):
                return (self.text_of(t) for t, _ in self.split(text))
            pattern = self.any
        return pattern.findall(text) if len(text) < _LONG else (m.group() for m in pattern.finditer(text))


@lru_cache(maxsize=4)
def _prepared(path: str):
    """(tokenizer, its pre-tokens of a text, form of vocabulary strings -> form of pre-tokens, merges) for a .json file."""
    tokenizer = _library(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = tokenizer.model, spec.get("pre_tokenizer") or {}
    if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        level = _ByteLevel(tokenizer)
        return tokenizer, level, level.text_of, lambda p: len(model.tokenize(level.letters_of(p)))
    normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    split = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda text: [(text, None)]
    return tokenizer, lambda text: [t for t, _ in split(normalise(text))], str, lambda p: len(model.tokenize(p))


def token_counter(path: str, whole: frozenset[str] | None) -> Callable[[str], int]:
    """A function from a text to its number of tokens, given the proved strings of ``path``."""
    if path.endswith(".model"):
        pieces = _pieces(path)
        if whole is None:
            return lambda text: len(pieces.encode(text))
        counts, segment = _Merged(whole, _piece_merges(path)), re.compile(f"{_SPACE}+[^{_SPACE}]*")
        return lambda text: counts.total(m.group() for m in segment.finditer(pieces.normalize(text)))
    if whole is None:
        tokenizer = _library(path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    tokenizer, pre_tokens, form, merge = _prepared(path)
    counts = _Merged((s for s in map(form, whole) if s is not None), merge)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    parts = re.compile("|".join(map(re.escape, special))) if special else None

    def count(text: str) -> int:
        if parts is None or not any(s in text for s in special):
            return counts.total(pre_tokens(text))
        plain = parts.split(text)
        return len(plain) - 1 + sum(counts.total(pre_tokens(p)) for p in plain)

    return count


_COUNTERS: dict[str, Callable[[str], int]] = {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text by the tokenizer file ``path`` (.json or .model).

    The counts are those of the file's own library without begin, end or added special tokens, truncation or padding;
    special strings inside texts are tokens where the library takes them so. Only ``doc_id`` and ``text`` are read. NULL
    texts are empty: 0 bytes, 0 tokens. NULL ids and repeated rows stay rows of their own; an empty table gives an empty
    table; texts of any length are counted whole, those of over 1 Mi characters without a list of their pre-tokens.
    No rows are exchanged. The proved strings are broadcast: they are at most the vocabulary.
    """
    spark = session_of(docs)
    path = path or tokenizer_path()
    proved = spark.sparkContext.broadcast(prove_whole_tokens(path))

    def run(batches: Batches) -> Batches:
        count = _COUNTERS.get(path)
        if count is None:
            count = _COUNTERS[path] = token_counter(path, proved.value)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            n_bytes = pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
