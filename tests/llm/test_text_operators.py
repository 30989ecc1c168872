"""Line dedup, n-gram join, toxicity and fingerprints against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from flowwarden.llm import fingerprints as fp
from flowwarden.llm.jaccard_join import ngram_jaccard_components, one_per_component
from flowwarden.llm.line_dedup import dedup_lines, removed_lines
from flowwarden.llm.toxicity import Model, fit_nnpu, score_toxicity, without_toxic
from flowwarden.llm.words import shingle_sets, word_hashes

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b, both = sets[j], len(a & sets[j])
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


def variants():
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 60, 120)]
    rows = []
    for k in range(60):
        words = base[: 40 + k]
        for at in rng.integers(0, len(words), k % 7):
            words[at] = f"v{at}{k}"
        rows.append((k, " ".join(words)))
    return rows + [(60 + n, " ".join(base[:n])) for n in range(9)] + [(70, "A b\tC d\ve"), (71, "a B c D E"), (72, "a b c d e f")]


@pytest.mark.parametrize("most", [16, 1])
def test_ngram_join_equals_brute_force(spark, documents, most):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + d, t) for d, t in variants()]
    got = ngram_jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), most=most).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_ngram_join_edges(spark):
    rows = [(3, None), (4, ""), (5, " \n"), (1, "a b c"), (2, "A  B\nC"), (2, "A  B\nC"), (None, "a b c"), (7, "x " * 30_000), (8, "x " * 29_000)]
    got = sorted(map(tuple, ngram_jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(3, 0, 3), (4, 0, 4), (5, 0, 5), (1, 1, 1), (2, 1, 1), (2, 1, 1), (None, 1, 1), (7, 1, 7), (8, 1, 7)], key=str)
    kept = one_per_component(spark.createDataFrame([(*r, "extra") for r in rows], f"{DOCS}, _n string"))
    assert kept.columns == ["doc_id", "text", "_n"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7]
    assert ngram_jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_keep_one(spark):
    kept = one_per_component(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "quite another text"), (2, "a b c")], DOCS))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c"), (1, "quite another text")]


def brute_lines(rows):
    lines, held, gone = [], defaultdict(list), defaultdict(set)
    for d, t in sorted(rows):
        for n, line in enumerate(t.split("\n")):
            s = frozenset(line.encode().lower().split())
            common = defaultdict(int)
            for w in s:
                for k in held[w]:
                    common[k] += 1
            if any(100 * c >= 75 * (len(s) + len(lines[k]) - c) for k, c in common.items()):
                gone[d].add(n)
            for w in s:
                held[w].append(len(lines))
            lines.append(s)
    return {d: (len(t.split("\n")), len(gone[d]), "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])) for d, t in rows}


@pytest.mark.parametrize("first", [2, 1])
def test_line_dedup_equals_brute_force(spark, documents, first, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(20_000 + d, t.replace(" w1 ", "\n")) for d, t in variants()]
    monkeypatch.setattr(removed_lines, "__defaults__", (75, first))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(spark):
    rows = [(2, "one two\n\nthree four five", "p"), (2, "one two\n\nthree four five", "p"), (1, "TWO one\n \n", "q"), (None, "three  four five", "r"),
            (5, None, "s"), (6, "", "t"), (2, "one  two\nnew words here", "u")]
    got = [(r.doc_id, r._id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, f"{DOCS}, _key string").withColumnRenamed("_key", "_id")).collect()]
    assert len(got) == 7
    by = {x[1]: x for x in got}
    assert by["r"] == (None, "r", 1, 0, "three  four five")  # a NULL id comes first
    assert by["q"] == (1, "q", 3, 0, "TWO one\n \n")
    assert by["p"] == (2, "p", 3, 2, "") and [x for x in got if x[1] == "p"] == [by["p"]] * 2
    assert by["u"][3:] == (1, "new words here")
    assert by["s"] == (5, "s", 0, 0, None) and by["t"] == (6, "t", 1, 0, "")
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_without_id_stay_apart(spark, monkeypatch):
    """Texts of NULL id whose text keys collide keep their own lines."""
    from flowwarden.llm import line_dedup

    monkeypatch.setattr(line_dedup, "_TEXT_BITS", 1)
    rows = [(None, f"alpha{d} beta{d} gamma{d}\nsame words everywhere\ndelta{d}") for d in range(12)] + [(1, "same words everywhere")]
    got = dedup_lines(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sum(r.n_removed for r in got) == 12 and sorted(r.n_removed for r in got if r.doc_id is None) == [0] + [1] * 11
    assert {t.split("\n")[0] for d, t in rows if d is None} == {r.text.split("\n")[0] for r in got if r.doc_id is None}
    assert all(r.text == "" for r in got if r.doc_id == 1)


def test_line_dedup_of_one_long_line(spark):
    long = " ".join(f"t{i}" for i in range(70_000))
    near = " ".join(f"t{i}" for i in range(60_000))
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame([(1, long), (2, near), (3, "t1 t2 t3")], DOCS)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_long_different_lines_need_no_second_sending(spark, monkeypatch):
    """Parity bits tell different lines of many common words apart; equal and similar lines still go."""
    from flowwarden.llm import line_dedup

    rng = random.Random(5)
    lines = [rng.sample([f"v{n}" for n in range(700)], 220) for _ in range(60)]
    rows = [(d, " ".join(words)) for d, words in enumerate(lines)]
    rows += [(100 + d, rows[d][1].upper()) for d in range(5)] + [(200 + d, " ".join(lines[d][:200])) for d in range(5)]
    monkeypatch.setattr(line_dedup, "_bits_of_lines", None)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_lines(rows) and sum(n for _, n, _ in got.values()) == 10


def test_equal_lines_are_no_candidates(spark):
    """Copies in other batches are decided by their content alone; a line meets the earliest of a set of copies only."""
    from flowwarden.llm import line_dedup, packets

    rows = [(d, "a b c d e f g h i j") for d in range(9, 0, -1)] + [(20, "a b c d e f g h i k")]
    identified = line_dedup._identified(spark.createDataFrame(rows, DOCS).repartition(10))
    rarity = spark.sparkContext.broadcast(np.zeros(line_dedup.BUCKETS, dtype=np.uint32))
    sent = identified.mapInArrow(line_dedup._emit(rarity, 4, 75), packets.SCHEMA)
    met = packets.exchange(sent, 4).mapInArrow(line_dedup._meet(75, 6, line_dedup._LONG_WIDE), line_dedup._FOUND_SQL).collect()
    assert sorted(r.id for r in met if r.kind == 0) == list(range(2, 10))
    assert {(r.id, r.id2) for r in met if r.kind == 1} == {(20, 1)}


def test_word_hashes_do_not_depend_on_blocks():
    text = ("Ab c\td " * 400_000).encode()
    one, _, _ = word_hashes([b"ab c d"])
    many, doc, _ = word_hashes([text, b"", b"D C"])
    assert (many[:3] == one).all() and (many[-5:-2] == one).all() and many[-2] == one[2] and doc[-1] == 2
    assert len(shingle_sets([text])[0]) == 3


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(1_500):
        text, bad = list(rng.choice(words, 40)), d % 9 == 0
        for k in range(3 if bad else 0):
            text[5 * k] = f"vile{rng.integers(0, 30)}"
        rows.append((d, " ".join(text)))
        labels.append((d, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (9_000, "")], DOCS)
    given = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, given).collect()
    assert len(got) == 1_502 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in [*range(1_500), 9_000] if zlib.crc32(str(d).encode()) % 4 == 2}
    right = sum(r.predicted == int(r.doc_id % 9 == 0) for r in held if r.doc_id < 9_000)
    assert right >= 0.98 * (len(held) - 1)
    clean = without_toxic(docs.withColumn("_toxicity", F.lit("kept")), given)
    assert clean.columns == ["doc_id", "text", "_toxicity"] and 1_300 <= clean.count() <= 1_345
    none = score_toxicity(docs, spark.createDataFrame([], given.schema))
    assert none.where("predicted = 1").count() == 0
    assert score_toxicity(spark.createDataFrame([], DOCS), given).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(d, f"text number {d}") for d in range(60)], DOCS)
    labels = spark.createDataFrame([(d, d % 2) for d in range(60)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert score_toxicity(docs, labels).sort("doc_id").collect() == score_toxicity(docs, turned).sort("doc_id").collect()


def test_nnpu_risk_needs_no_negatives():
    def row(*buckets):
        return np.array([[-1, *buckets], [10, *[1] * len(buckets)]], dtype=np.int32)

    rng = np.random.default_rng(3)
    positive = [row(1, *rng.integers(10, 1000, 8)) for _ in range(200)]
    unlabelled = [row(*([1] if k % 10 == 0 else []), *rng.integers(10, 1000, 8)) for k in range(1_000)]
    model = fit_nnpu(positive, unlabelled, 0.1)
    assert isinstance(model, Model) and model.weights[1] > 2 and np.flatnonzero(model.weights).tolist() == [1]


def test_syncmers_are_context_free():
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    one, two = fp.anchors([passage])[0], fp.anchors(["é€𝄞" * 30 + passage + "zz"])[0]
    assert set(one[0].tolist()) <= set(two[0].tolist())
    at = dict(zip(two[0].tolist(), two[1].tolist()))
    assert all(at[h] <= p + 90 for h, p in zip(*map(np.ndarray.tolist, one)))
    brute = [i for i in range(len(passage) - fp.K + 1)]
    assert 0.1 < len(one[0]) / len(brute) < 0.35


def test_fingerprints_equal_brute_force(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.doc_id: r for r in fp.compare_with_edits(documents.repartition(3)).collect()}
    for k, (d, t) in enumerate(rows):
        n, following = len(t), rows[(k + 1) % len(rows)][1]
        changed = t[: n - n // 2] + following[: n // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert got[d].fingerprint == fp.encode(fp.anchors([t])[0])
        assert got[d].near_edited == pytest.approx(fp.likeness(got[d].fingerprint, got[d].edited_fingerprint))


def test_fingerprint_edges(spark):
    rows = [(None, "null first " * 9), (1, None), (2, ""), (3, "short"), (4, "same text " * 20), (4, "same text " * 20), (5, "𝄞" * 700_000)]
    got = fp.compare_with_edits(spark.createDataFrame([(*r, 1) for r in rows], f"{DOCS}, range int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].near_next == 1.0 and by[2].near_next == 0.0 and by[1].fingerprint == ""
    assert by[5].n_chars == 700_000 and by[5].near_edited > 0
    assert fp.likeness(by[4].fingerprint, by[4].fingerprint) == 1.0
    assert fp.matches(by[4].fingerprint, by[4].fingerprint)
    single = fp.compare_with_edits(spark.createDataFrame([(1, "abcdefgh")], DOCS)).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest()
    assert fp.compare_with_edits(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_of_long_texts_are_found(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefghij ")
    passage, one, two = ("".join(rng.choice(letters, n)) for n in (500, 20_000, 20_000))
    one, two = one[:7_000] + passage + one[7_000:], two[:15_000] + passage + two[15_000:18_000] + passage + two[18_000:]
    by = {r.doc_id: r for r in fp.compare_with_edits(spark.createDataFrame([(1, one), (2, two)], DOCS)).collect()}
    inside = [p for p, _ in fp.matches(by[1].fingerprint, by[1].fingerprint) if 7_000 <= p <= 7_500 - fp.K]
    found = fp.matches(by[1].fingerprint, by[2].fingerprint)
    assert len(inside) > 80
    assert {(p, p + shift) for p in inside for shift in (8_000, 11_500)} <= set(found)

    def grams(text):
        return {text[p : p + fp.K] for p in fp.decode(fp.fingerprint_documents(spark.createDataFrame([(0, text)], DOCS)).first().fingerprint)[1]}

    a, b, c = grams(one), grams(two), grams(fp.edited(one, two))
    assert by[1].near_next == pytest.approx(2 * len(a & b) / (len(a) + len(b)))
    assert by[1].near_edited == pytest.approx(2 * len(a & c) / (len(a) + len(c)))
