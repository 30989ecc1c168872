"""Ranked lexical search by pipelined term partitioning.

The index is partitioned by term: each of a few owners holds the postings of its terms, the rarest terms
with the first owner. A bundle of items travels through the owners one after the other; at each it meets, by
cogroup on the block of documents, the postings of its terms, and adds their whole-number contributions to the
sparse document accumulators it carries. What reaches the end is final and the best are selected.

Between owners an accumulator is dropped, and none is opened, where even the greatest contributions of all terms
still to come cannot reach the score that enough documents already have. That is lossless.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import scratch_path
from .packets import pack, unpack
from .store import Batches, key_of_doc, session_of, stored, text_of

TOP = 20
#: Share of all postings with each owner but the last, rarest terms first.
SHARES = (0.05, 0.15, 0.3)
#: Items that travel together; different item texts of one round and their bytes: more of them make more rounds.
BUNDLE, ROUND_ITEMS, ROUND_BYTES = 256, 4_096, 16 << 20
_NULL_ID = -(2**63)

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))

_POSTINGS = "block long, n_docs int, doc_ids binary, postings binary, owner int"
_STATE, _PACKED = "block long, bundle int, payload binary", ["int32", "int32", "int64"]
_FOUND = "item long, doc_id long, score long"


def terms_of(text: str | bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    data = text.encode() if isinstance(text, str) else text
    return data.translate(_TABLE).split()


def _texts(column) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _statistics(rows: DataFrame, terms) -> DataFrame:
    """Per item term the documents that hold it, the greatest tf and the least length beside it; the row without term
    holds the documents with terms (df) and all their terms (n_least)."""

    def run(batches: Batches) -> Batches:
        code: dict[bytes, int] = terms.value
        df = np.zeros(len(code) + 1, dtype=np.int64)
        most, least = np.zeros(len(code), dtype=np.int64), np.full(len(code), np.iinfo(np.int64).max)
        total = 0
        for batch in batches:
            for text in _texts(batch.column(1)):
                words = terms_of(text)
                n = len(words)
                total += n
                df[-1] += n > 0
                found = [(code[w], k) for w, k in Counter(words).items() if w in code]
                if found:
                    t, tf = np.array(found, dtype=np.int64).T
                    df[t] += 1
                    most[t] = np.maximum(most[t], tf)
                    least[t] = np.minimum(least[t], n)
        at = np.flatnonzero(df[:-1])
        out = [np.append(at, -1), np.append(df[at], df[-1]), np.append(most[at], 0), np.append(least[at], total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["term", "df", "tf_most", "n_least"])

    found = rows.mapInArrow(run, "term long, df long, tf_most long, n_least long")
    least = F.when(F.col("term") < 0, F.sum("n_least")).otherwise(F.min("n_least"))
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.max("tf_most").alias("tf_most"), least.alias("n_least"))


def _part(tf, n, n_docs: int, n_terms: int):
    """A document's share of a term's weight, in millionths."""
    m = 100 - 25 + 25 * n * n_docs // n_terms
    return (10**9 * tf) // (1000 * tf + 12 * m)


def _index(rows: DataFrame, terms, owner_of: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """One row per owner and block of documents: the owner's postings of the block.

    Packed are the terms in rising order, the bounds of their postings, and of each posting the document's place in the
    block and its share of the term's weight. The last owner's rows hold the ids of the block's documents as well.
    """
    owners = len(SHARES) + 1

    def run(batches: Batches) -> Batches:
        code: dict[bytes, int] = terms.value
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            found: list[tuple] = []
            for place, text in enumerate(_texts(batch.column(1))):
                words = terms_of(text)
                found += [(code[w], place, k, len(words)) for w, k in Counter(words).items() if w in code]
            if not found:
                continue
            term, place, tf, n = np.array(found, dtype=np.int64).T
            part = _part(tf, n, n_docs, n_terms)
            order = np.argsort(term, kind="stable")
            term, place, part = term[order], place[order].astype(np.int32), part[order].astype(np.int32)
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64).tobytes()
            packed = []
            for owner in range(owners):
                own = owner_of[term] == owner
                held, bounds = np.unique(term[own], return_index=True)
                packed.append(pack([held.astype(np.int32), np.append(bounds, own.sum()).astype(np.int32), place[own], part[own]]))
            yield pa.RecordBatch.from_arrays([
                pa.array([first + number] * owners, pa.int64()), pa.array([batch.num_rows] * owners, pa.int32()),
                pa.array([None] * (owners - 1) + [ids], pa.binary()), pa.array(packed, pa.binary()), pa.array(range(owners), pa.int32()),
            ], names=["block", "n_docs", "doc_ids", "postings", "owner"])

    return rows.mapInArrow(run, _POSTINGS)


class _Plan:
    """What the owners know of one round's items; broadcast, bounded by ROUND_ITEMS and ROUND_BYTES."""

    def __init__(self, items: list[Counter], weight: np.ndarray, greatest: np.ndarray, owner_of: np.ndarray, owners: int):
        bundles = -(-len(items) // BUNDLE)
        found: list[list[dict[int, list]]] = [[defaultdict(list) for _ in range(bundles)] for _ in range(owners)]
        to_come = np.zeros((owners, bundles * BUNDLE), dtype=np.int64)
        for item, terms in enumerate(items):
            for term, repeats in terms.items():
                times = int(weight[term]) * repeats
                found[owner_of[term]][item // BUNDLE][term].append((item % BUNDLE, times))
                to_come[: owner_of[term], item] += times * int(greatest[term])
        #: by owner and bundle: the places in the bundle of the items that hold a term, with weight times repeats
        self.wanted = [[{t: np.array(pairs, dtype=np.int64).T for t, pairs in by_term.items()} for by_term in by_bundle] for by_bundle in found]
        #: by owner and bundle: the most that the terms of later owners can add to an item's score
        self.to_come = to_come.reshape(owners, bundles, BUNDLE)


def _visit(plan, owner: int, floors, top: int):
    """The cogroup function of one owner: the bundles of a block, and the owner's postings of that block.

    Of each item stay the accumulators that may still end among its ``top``.
    """

    def survivors(bundle: int, held: bytes | None, found: dict, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = np.zeros((BUNDLE, n_docs), dtype=np.int64)
        if held is not None:
            item, place, score = unpack(held, _PACKED)
            scores[item, place] = score
        wanted = plan.value.wanted[owner][bundle]
        for term in wanted.keys() & found.keys():
            items, times = wanted[term]
            place, part = found[term]
            scores[items[:, None], place] += times[:, None] * part
        floor = floors.value[bundle].copy()
        if n_docs >= top:
            floor = np.maximum(floor, np.partition(scores, n_docs - top, axis=1)[:, n_docs - top])
        item, place = np.nonzero((scores > 0) & (scores + plan.value.to_come[owner][bundle][:, None] >= floor[:, None]))
        return item, place, scores[item, place]

    last = owner == len(SHARES)

    def run(key, bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        (n_docs, ids, payload), = zip(postings["n_docs"], postings["doc_ids"], postings["postings"])
        terms, bounds, place, part = unpack(payload, ["int32"] * 4)
        found = {int(t): (place[a:b], part[a:b].astype(np.int64)) for t, a, b in zip(terms, bounds[:-1], bounds[1:])}
        held = dict(zip(bundles["bundle"], bundles["payload"]))
        out = []
        for bundle in range(len(plan.value.wanted[owner])):
            item, at, score = survivors(bundle, held.get(bundle), found, int(n_docs))
            if len(item) and last:
                doc = np.frombuffer(ids, dtype=np.int64)[at]
                best = _best(item, score, doc, top)
                out.append(pd.DataFrame({"item": item[best] + bundle * BUNDLE, "doc_id": doc[best], "score": score[best]}))
            elif len(item):
                packed = pack([item.astype(np.int32), at.astype(np.int32), score])
                out.append(pd.DataFrame({"block": [key[0]], "bundle": [bundle], "payload": [packed]}))
        names = ["item", "doc_id", "score"] if last else ["block", "bundle", "payload"]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    return run


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Positions of each item's ``top`` entries, highest score first, smaller doc first among equals."""
    order = np.lexsort((doc, -score, item))
    of = item[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < top]


def _reached(state: DataFrame, top: int, shape: tuple[int, int]) -> np.ndarray:
    """Per bundle and item the score that ``top`` accumulators have reached, 0 where fewer are open."""

    def run(batches: Batches) -> Batches:
        item, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            for bundle, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, _, more = unpack(payload, _PACKED)
                item, score = np.append(item, place + np.int64(bundle * BUNDLE)), np.append(score, more)
                best = _best(item, score, np.zeros_like(item), top)
                item, score = item[best], score[best]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score)], names=["item", "score"])

    best = state.select("bundle", "payload").mapInArrow(run, "item long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
    floors = np.zeros(shape, dtype=np.int64)
    for row in best.withColumn("rank", rank).where(F.col("rank") == top).collect():
        floors[row["item"] // BUNDLE, row["item"] % BUNDLE] = row["score"]
    return floors


def _owners(df: np.ndarray) -> np.ndarray:
    """The owner of each term: rarest terms first, each owner but the last up to its share of all postings."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) / max(int(df.sum()), 1)
    out = np.empty(len(df), dtype=np.int64)
    out[order] = np.searchsorted(np.cumsum(SHARES), before, "left")
    return out


def _search(rows: DataFrame, texts: list[str], top: int) -> DataFrame:
    """(item, doc_id, score) of the best documents for the texts of one round; item is the place in ``texts``."""
    spark = rows.sparkSession
    counted = [Counter(terms_of(t)) for t in texts]
    code = {w: k for k, w in enumerate(sorted(set().union(*counted)))}
    items = [Counter({code[w]: k for w, k in c.items()}) for c in counted]
    terms = spark.sparkContext.broadcast(code)

    df, tf_most, n_least = (np.zeros(len(code), dtype=np.int64) for _ in range(3))
    n_docs = n_terms = 0
    for row in _statistics(rows, terms).collect():
        if row["term"] < 0:
            n_docs, n_terms = row["df"], row["n_least"]
        else:
            df[row["term"]], tf_most[row["term"]], n_least[row["term"]] = row["df"], row["tf_most"], row["n_least"]
    if not n_docs or not df.any():
        return spark.createDataFrame([], _FOUND)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], dtype=np.int64)
    owner_of, owners = _owners(df), len(SHARES) + 1
    plan = spark.sparkContext.broadcast(_Plan(items, weight, _part(tf_most, n_least, n_docs, n_terms), owner_of, owners))

    path = scratch_path(spark, "postings")
    _index(rows, terms, owner_of, n_docs, n_terms).write.partitionBy("owner").parquet(path)
    index = spark.read.schema(_POSTINGS).parquet(path)
    state = spark.createDataFrame([], _STATE)
    floors = np.zeros(plan.value.to_come.shape[1:], dtype=np.int64)
    for owner in range(owners):
        last = owner == owners - 1
        visit = _visit(plan, owner, spark.sparkContext.broadcast(floors), top)
        postings = index.where(F.col("owner") == owner).drop("owner")
        met = state.groupBy("block").cogroup(postings.groupBy("block")).applyInPandas(visit, _FOUND if last else _STATE)
        state = stored(met, f"accumulators_{owner}")
        if not last:
            floors = _reached(state, top, floors.shape)
    return state


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item, rank from 1.

    A document's score sums, over the item's terms with repeats, weight * ((10^9 tf) div (1000 tf + 12 m)) with
    weight = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 75 + (25 n N) div L; equal scores are ranked by ascending
    doc_id. Documents of score 0 are not returned.

    ``docs`` holds doc_id and text, ``items`` item_id and text; other columns are not read. NULL texts and texts without
    terms hold no terms. Repeated documents are ranked each for itself, NULL ids like the smallest id and returned as NULL;
    equal item texts are searched once and every item row gets the result. Empty tables give an empty result. Texts of any
    length count whole. Items are searched in rounds of about ROUND_ITEMS different texts, so that what is broadcast stays
    bounded whatever the number of items.
    """
    spark = session_of(docs)
    rows = docs.select(key_of_doc().alias("doc_id"), text_of(docs).alias("text"))
    asked = items.select(F.col("item_id"), text_of(items).alias("item_text"))
    distinct = asked.select("item_text").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes")).first()
    rounds = max(1, -(-size["n"] // ROUND_ITEMS), -(-size["bytes"] // ROUND_BYTES))
    found = []
    for r in range(rounds):
        texts = sorted(x[0] for x in distinct.where(F.pmod(F.xxhash64("item_text"), F.lit(rounds)) == r).collect())
        numbered = spark.createDataFrame(list(enumerate(texts)), "item long, item_text string")
        found.append(_search(rows, texts, top).join(numbered, "item"))
    order = W.partitionBy("item_text").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    doc_id = F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id")
    return asked.join(ranked, "item_text").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")


#: DuckDB form of the ranking of all documents for the benchmark items.
ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
item AS (SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM doc),
tf AS (SELECT d, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT d, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc) GROUP BY d, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
score AS (SELECT i, item_id, d, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))))) AS BIGINT) AS score
    FROM (SELECT i, item_id, unnest(terms) AS term FROM item) JOIN tf USING (term) JOIN weight USING (term), total GROUP BY i, item_id, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
