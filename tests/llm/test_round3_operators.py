"""Whitening, ranked search and token counts against brute force and the tokenizers' own libraries."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from conftest import SF
from flowwarden.llm import ranked_search as rs, token_counts as tc, whitening as wh
from flowwarden.llm.queries import QUERIES

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("low, high", [(-300, 300), (-(2**62), 2**62), (5, 5)])
def test_scatter_is_exact(low, high):
    x = np.random.default_rng(1).integers(low, high, (150, 5), endpoint=True)
    x[:, 3] = x[:, 1]
    sums, products = wh.scatter(x)
    exact = x.astype(object)
    assert sums == list(exact.sum(axis=0))
    assert all(products[i][j] == int((exact[:, i] * exact[:, j]).sum()) for i in range(5) for j in range(i, 5))
    assert [sum(v << (wh._LIMB * k) for k, v in enumerate(wh._limbs(p))) for p in (sums[0], products[0][4], -products[2][2])] == [
        sums[0], products[0][4], -products[2][2]]


def brute_whitening(rows):
    """rows: (key, floats); returns n, S, the covariance and {key: x} of the usable rows."""
    width = max(len(v) for _, v in rows if v is not None)
    usable = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows
              if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in usable))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[float(Fraction(sum(n * x[i] * n * x[j] for x in fit) - n * sums[i] * sums[j], n**3)) for j in range(width)] for i in range(width)]
    return n, sums, np.array(cov), usable


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += rows[:50] + [(None, rows[0][1]), (900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5), (904, [float("nan")] * 6), (905, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, x int")
    got = wh.whiten(df.repartition(3)).collect()
    n, sums, cov, usable = brute_whitening(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(usable) and {r.n for r in got} == {n}
    expected = Counter((k, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for k, x in usable)
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == expected
    by_key = {(r.vec_id, r.component): r for r in got}
    for k, x in usable:
        for c in range(4):
            r = by_key[k, c + 1]
            w = (np.array(x) - np.array(sums) / n) @ axes[:, c] / math.sqrt(values[c])
            assert abs(abs(w) - abs(r.whitened)) < 1e-9 and abs(r.explained - values[c] / values.sum()) < 1e-12
    signs = {c: {np.sign(by_key[k, c].whitened) * np.sign((np.array(x) - np.array(sums) / n) @ axes[:, c - 1]) for k, x in usable} for c in (1, 2, 3, 4)}
    assert all(len(s) == 1 for s in signs.values())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.whitened, r.deviation, r.explained) for r in same] == [(1, 0.0, 0, 0.0)] * 4
    wide = wh.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 0.0])], schema)).collect()
    x = int(256 * float(np.float32(1e15)))
    assert {int(r.deviation) for r in wide} == {(2 * x) ** 2} and {abs(r.whitened) for r in wide if r.component == 1} == {1.0}


def test_whitening_query_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, sums, cov, usable = brute_whitening(rows)
    got = QUERIES["op11_whitening"](spark, SF).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for k, x in usable}
    assert got[0].identity_error < 1e-9


def brute_ranking(docs, items, top):
    split = [(d, rs.terms_of(t or "")) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for d, words in split:
            tf, score = Counter(words), 0
            for w in rs.terms_of(text or ""):
                if tf[w]:
                    m = 100 - 25 + ((25 * len(words) * n_docs) // n_terms)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score:
                scored.append((-score, -(2**63) if d is None else d, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(rs, "BUNDLE", 4)
    monkeypatch.setattr(rs, "ROUND_ITEMS", 9)
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{int(z)}" for z in range(60)] + ["É", "日本", "AbC", "x-y", "x\x7fy"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(i, draw(int(rng.integers(0, 60)))) for i in range(300)] + [(300, None), (301, "..."), (302, "É é " * 3), (None, draw(20)), (-5, "w1 " * 5000)]
    docs += docs[:40]
    items = [(i, draw(int(rng.integers(0, 12)))) for i in range(25)] + [(30, None), (31, "!"), (32, "not there"), (None, "w3 w3 w9"), (2, "w3 w3 w9")]
    got = rs.rank_documents(spark.createDataFrame([(*d, 0) for d in docs], f"{DOCS}, item_id int").repartition(5),
                            spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int"), 7)
    assert Counter(map(tuple, got.collect())) == Counter(brute_ranking(docs, items, 7))


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.rank_documents(docs, items).count() == 0
    assert rs.rank_documents(spark.createDataFrame([(1, "a"), (2, None)], DOCS), items.limit(0)).count() == 0
    assert rs.rank_documents(spark.createDataFrame([(1, None), (2, "b")], DOCS), items).count() == 0


HARD = ["", None, "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "  \n\n x\u0085y\u001c z", " a b　", "it's they'LL 've  12three ٣٤ ½ ²",
        "\U0001f600 é é \U0001e030\U0001fae8 ᲉꟚ\U0002ebf0", "▁a ▁▁b", "\x00\x1f", "Ġthe Ġ the", "x" * 3000, " " * 500 + "a", "a\t b\r\n\r\n c", "</w>the</w>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, monkeypatch, name):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert tc.prove_whole_tokens(path)
    monkeypatch.setattr(tc, "_LONG", 1000)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + HARD + HARD
    if name.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(pieces.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = [(i if i % 7 else None, t, "n") for i, t in enumerate(texts)]
    got = tc.count_tokens(spark.createDataFrame(rows, f"{DOCS}, n_tokens string"), path, limit=100).collect()
    want = Counter((i, len((t or "").encode()), (n := count(t or "")), n > 100) for i, t, _ in rows)
    assert Counter(map(tuple, got)) == want
    assert tc.count_tokens(spark.createDataFrame([], DOCS), path).count() == 0


def test_shortcut_only_where_it_is_proved(tmp_path):
    """Strings that the merges cannot reach alone are not proved; a file with stripping special tokens has no proof."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if i < 256} | {"th": 256, "xyz": 257, "<|endoftext|>": 258}
    spec["model"]["merges"] = [["t", "h"]]
    spec["added_tokens"][0]["id"] = 258
    small = tmp_path / "small.json"
    small.write_text(json.dumps(spec))
    proved = tc.prove_whole_tokens(str(small))
    assert "th" in proved and "xyz" not in proved
    assert tc.token_counter(str(small), proved)("th xyz<|endoftext|>") == 1 + 4 + 1
    spec["added_tokens"][0]["lstrip"] = True
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps(spec))
    assert tc.prove_whole_tokens(str(odd)) is None
    assert tc.token_counter(str(odd), None)("th  <|endoftext|>") == 2


def test_a_class_the_library_sees_otherwise_goes_to_the_library(monkeypatch):
    path = tc.tokenizer_path()
    count = tc.token_counter(path, tc.prove_whole_tokens(path))
    level = tc._prepared(path)[1]
    level.differing.add("é")
    try:
        from tokenizers import Tokenizer

        assert count("café été") == len(Tokenizer.from_file(path).encode("café été").ids)
    finally:
        level.differing.discard("é")
