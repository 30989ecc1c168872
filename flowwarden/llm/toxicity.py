"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents, whatever their labels, are the
unlabelled side, whose share of positives is the class prior. The risk estimator subtracts the
positives hidden in the unlabelled side and is kept from falling below zero. The model is a
sparse linear one over hashed words and word beginnings, trained with numpy on a bounded sample
and broadcast as a table of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import Batches, session_of, stored, text_of, whole_row
from .words import PUNCTUATION, mix, word_hashes

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
POSITIVES = 6_000
UNLABELLED = 12_000
THRESHOLD = 0.3
SUPPORT = 100
EXCESS = 6
_U = np.uint64


def features(texts: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, occurrences) of each feature and the words of each text.

    Features are hashed words and hashed first bytes of words; ``keep`` masks buckets.
    """
    words, doc, _, *short = word_hashes(texts, PUNCTUATION, PREFIXES)
    parts = []
    for kind, h in enumerate((words, *short)):
        bucket = (mix(h + _U(kind)) % _U(BUCKETS)).astype(np.int64)
        code = doc * BUCKETS + bucket
        parts.append(code if keep is None else code[keep[bucket]])
    code, times = np.unique(np.concatenate(parts), return_counts=True)
    return code // BUCKETS, code % BUCKETS, times, np.bincount(doc, minlength=len(texts))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    length_weight: float
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability of the positive class of each text."""
        doc, bucket, times, words = features(texts, self.weights != 0)
        margin = np.bincount(doc, weights=self.weights[bucket] * np.log2(1 + times), minlength=len(texts))
        margin = margin + self.bias + self.length_weight * np.log2(1 + words)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def without_copies(rows: list[np.ndarray], bands: int = 6, width: int = 3) -> list[np.ndarray]:
    """``rows`` less those that share a band of minimum hashes with an earlier one: near copies teach their own words."""
    salts = mix(np.arange(1, bands * width + 1, dtype=np.uint64))
    seen: set[tuple] = set()
    out = []
    for row in rows:
        lowest = [int(mix(row[0, 1:].astype(np.uint64) ^ s).min()) if row.shape[1] > 1 else 0 for s in salts]
        keys = [(b, *lowest[b * width : (b + 1) * width]) for b in range(bands)]
        if not any(k in seen for k in keys):
            out.append(row)
        seen.update(keys)
    return out


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 100, rate: float = 0.1,
    sparsity: float = 3e-4, least: int | None = None,
) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic losses.

    Rows are arrays of bucket numbers, occurrences and, first, (-1, words of the text). Where the corrected negative risk is below zero the step raises it.
    Buckets met in fewer than ``least`` positives that are no near copies of each other (by default 3, or one
    in ``SUPPORT`` where that is more) have no weight, so that words of a few copied documents teach nothing; nor have those less than ``EXCESS`` standard
    deviations more frequent in positives than in the unlabelled rows. Adam over whole passes, with soft thresholds.
    """
    n, m = len(positive), len(unlabelled)

    def buckets(rows: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([*[r[0, 1:] for r in rows], np.empty(0, np.int32)])

    def counts(rows: list[np.ndarray]) -> np.ndarray:
        return np.bincount(buckets(rows), minlength=BUCKETS)

    support = counts(without_copies(positive)) >= (max(3, n // SUPPORT) if least is None else least)
    expected = n * (counts(unlabelled) + 3) / m
    known = support & (counts(positive) >= expected + EXCESS * np.sqrt(expected))
    length = np.log2(1 + np.array([r[1, 0] for r in (*positive, *unlabelled)]))
    rows = [r[:, 1:][:, known[r[0, 1:]]] for r in (*positive, *unlabelled)]
    doc = np.repeat(np.arange(len(rows)), [r.shape[1] for r in rows])
    bucket = np.concatenate([*[r[0] for r in rows], np.empty(0, np.int32)])
    value = np.log2(1 + np.concatenate([*[r[1] for r in rows], np.empty(0, np.int32)]))
    used, column = np.unique(bucket, return_inverse=True)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    of_length = 0.0
    first, second = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    for t in range(1, steps + 1):
        g = b + of_length * length + np.bincount(doc, weights=w[column] * value, minlength=n + m)
        p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        negative = -np.log1p(-np.minimum(p, 1 - 1e-12))  # the loss of the label -1
        corrected = negative[n:].mean() - prior * negative[:n].mean()
        slope = np.empty(n + m)
        if corrected >= 0:
            slope[:n] = prior / n * (p[:n] - 1) - prior / n * p[:n]
            slope[n:] = p[n:] / m
        else:
            slope[:n] = prior / n * p[:n]
            slope[n:] = -p[n:] / m
        grad = np.append(np.bincount(column, weights=slope[doc] * value, minlength=len(used)), [slope @ length, slope.sum()])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        w = w - step[:-2]
        of_length -= step[-2] / 10
        b -= step[-1]
        shrink = rate * sparsity / (np.sqrt(second[:-2] / (1 - 0.99**t)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, float(of_length), float(b))


def held_out(doc_id: Column | None = None) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on hash samples of about ``positives`` labelled toxic and ``unlabelled`` other documents (the bounds of the fit).

    Labels of held-out rows are not read and their texts not used. The class prior is the toxic share of the
    labels. A doc_id labelled both ways counts as toxic. Without toxic labels every score is 0.
    """
    session_of(docs)
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)).alias("toxic")).first()
    if not counts["toxic"]:
        return Model(np.zeros(BUCKETS), 0.0, -40.0)
    prior = min(max(counts["toxic"] / counts["n"], 1e-4), 0.5)
    usable = docs.where(~held_out()).select("doc_id", text_of(docs).alias("text"))
    total = max(1, usable.select("doc_id").count())

    def place(salt: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)

    chosen = known.where((F.col("toxic") > 0) & (place(1) < positives / counts["toxic"])).select("doc_id", F.lit(True).alias("positive"))
    rows = usable.join(F.broadcast(chosen), "doc_id", "left").select(
        "text", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce(place(2) < unlabelled / total, F.lit(False)).alias("other"))

    def extract(batches: Batches) -> Batches:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            doc, bucket, times, words = features(texts)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            data = [np.stack([np.append(-1, bucket[a:b]), np.append(n, times[a:b])]).astype("<i4").tobytes()
                    for n, a, b in zip(words, ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column(1), batch.column(2)], names=["data", "positive", "other"])

    def fit(batches: Batches) -> Batches:
        p, u = [], []
        for batch in batches:
            for data, positive, other in zip(*[c.to_pylist() for c in batch.columns]):
                row = np.frombuffer(data, dtype="<i4").reshape(2, -1)
                if positive:
                    p.append(row)
                if other:
                    u.append(row)
        if p and u:
            # The same rows in another order give another rounding: sort for equal reruns.
            key = lambda x: (x.size, x.tobytes())
            model = fit_nnpu(sorted(p, key=key), sorted(u, key=key), prior)
            used = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.bias]), pa.array([model.length_weight]), pa.array([used.tolist()], pa.list_(pa.int64())), pa.array([model.weights[used].tolist()], pa.list_(pa.float64()))],
                names=["bias", "length_weight", "buckets", "weights"])

    # The sample is bounded, so one task fits it; the driver gets the weights only.
    sample = stored(rows.where("positive or other").mapInArrow(extract, "data binary, positive boolean, other boolean"), "sample")
    found = sample.repartition(1).mapInArrow(fit, "bias double, length_weight double, buckets array<long>, weights array<double>").collect()
    weights = np.zeros(BUCKETS)
    if not found:
        return Model(weights, 0.0, float(np.log(prior / (1 - prior))))
    weights[found[0]["buckets"]] = found[0]["weights"]
    return Model(weights, found[0]["length_weight"], found[0]["bias"])


def score_column(docs: DataFrame, model: Model) -> Column:
    """The score of ``text`` (NULL as empty) as a double between 0 and 1."""
    shared = session_of(docs).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t.encode() for t in texts]), index=texts.index)

    return score(text_of(docs))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    Whole texts are scored; NULL and empty texts get the score of a text without features. Repeated rows and
    NULL ids get rows of their own. Empty tables are allowed.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns are kept."""
    model = train(docs, labels)
    scored = docs.select(whole_row(docs), score_column(docs, model).alias("score"))
    return scored.where(F.col("score") < threshold).select("row.*")
