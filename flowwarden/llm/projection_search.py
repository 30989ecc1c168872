"""Approximate nearest neighbours by stable projections indexed with kd-trees.

Largest inner product becomes smallest Euclidean distance when each vector gets one more
component that lifts it to the largest norm M. A Gaussian projection to a few dimensions keeps
distances in law: |P x|^2 / |x|^2 is chi-square. Rows are dealt to cells of a kd-tree over the
projected space (fitted on a bounded sample); each cell holds a kd-tree of its own rows. A query
takes projected neighbours nearest first, verifies their true inner products, and stops once
the next projected distance is so large that a chi-square test rules out nearer true neighbours:
first in its own cell, then in every other cell that the test leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .store import Batches, session_of, shuffle_partitions, stored

DIMENSIONS = 8
CONFIDENCE = 0.98
CELL_ROWS = 4_096
MOST_CELLS = 2_048
SAMPLE = 20_000
LEAF = 32


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number m of degrees of freedom."""
    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))

    low, high = 0.0, 10.0 * m + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > 1 - p else (low, middle)
    return high


@dataclass(frozen=True)
class Cells:
    """A kd-tree over the projected space: inner nodes split one dimension, leaves are cells with boxes."""

    dimension: list[int]
    value: list[float]
    left: list[int]
    right: list[int]
    low: np.ndarray
    high: np.ndarray

    def of(self, z: np.ndarray) -> np.ndarray:
        out = np.empty(len(z), dtype=np.int64)
        stack = [(0, np.arange(len(z)))] if self.dimension else []
        if not stack:
            out[:] = 0
        while stack:
            node, rows = stack.pop()
            below = z[rows, self.dimension[node]] < self.value[node]
            for child, part in ((self.left[node], rows[below]), (self.right[node], rows[~below])):
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    stack.append((child, part))
        return out

    def distances(self, z: np.ndarray) -> np.ndarray:
        """Squared distance from each projected query to each cell's box."""
        outside = np.maximum(np.maximum(self.low[None] - z[:, None], z[:, None] - self.high[None]), 0)
        return (outside**2).sum(axis=2)


def build_cells(sample: np.ndarray, cells: int, m: int) -> Cells:
    dimension, value, left, right, low, high = [], [], [], [], [], []

    def leaf(box) -> int:
        low.append(box[0])
        high.append(box[1])
        return -len(low)

    def grow(rows: np.ndarray, parts: int, box) -> int:
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(m)
        d = int(np.argmax(spread))
        if parts < 2 or len(rows) < 4 or spread[d] == 0:
            return leaf(box)
        cut = float(np.median(rows[:, d]))
        if cut == rows[:, d].min():
            cut = float(rows[rows[:, d] > cut, d].min())
        node = len(dimension)
        dimension.append(d)
        value.append(cut)
        left.append(0)
        right.append(0)
        top, bottom = box[1].copy(), box[0].copy()
        top[d] = bottom[d] = cut
        left[node] = grow(rows[rows[:, d] < cut], parts // 2, (box[0], top))
        right[node] = grow(rows[rows[:, d] >= cut], parts - parts // 2, (bottom, box[1]))
        return node

    grow(sample, cells, (np.full(m, -np.inf), np.full(m, np.inf)))
    return Cells(dimension, value, left, right, np.array(low), np.array(high))


class Tree:
    """The rows of one block in the leaves of a kd-tree over their projections, with the leaves' bounding boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, z: np.ndarray):
        order, bounds, stack = [], [0], [np.arange(len(ids))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                order.append(rows)
                bounds.append(bounds[-1] + len(rows))
                continue
            part = z[rows]
            d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            rows = rows[np.argpartition(part[:, d], len(rows) // 2)]
            stack += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        at = np.concatenate(order)
        self.ids, self.vectors, self.bounds = ids[at], vectors[at], np.array(bounds)
        self.low = np.minimum.reduceat(z[at], self.bounds[:-1])
        self.high = np.maximum.reduceat(z[at], self.bounds[:-1])

    def search(self, own: int, q: np.ndarray, zq: np.ndarray, k: int, lift: float, limit: float, factor: float):
        """(ids, scores) of the k best rows found; ``limit`` is a known bound of the k-th squared distance."""
        outside = np.maximum(np.maximum(self.low - zq, zq - self.high), 0)
        near = (outside**2).sum(axis=1)
        order = np.argsort(near, kind="stable")
        ids, scores = np.empty(0, np.int64), np.empty(0)
        at, take = 0, 8
        while at < len(order) and near[order[at]] <= factor * limit:
            leaves = order[at : at + take]
            leaves = leaves[near[leaves] <= factor * limit]
            rows = np.concatenate([np.arange(self.bounds[x], self.bounds[x + 1]) for x in leaves])
            rows = rows[self.ids[rows] != own]
            ids, scores = np.append(ids, self.ids[rows]), np.append(scores, self.vectors[rows] @ q)
            if len(ids) > k:
                # All rows that tie with the k-th stay in until the order by id decides.
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= cut
                ids, scores = ids[keep], scores[keep]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                limit = min(limit, max(lift - 2 * float(scores.min()), 0.0))
            at, take = at + take, take * 2
        return ids, scores


def _usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, data, norm): vectors that take part, as doubles."""
    v = F.col("v")
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).where(F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(rows: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
            m: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row with ``is_query(vec_id)``.

    Candidates are all rows but the query's own; ties go to the smaller vec_id. Vectors that are NULL, empty,
    zero or hold NULL or non-finite components take no part, nor do NULL ids and vectors that have not the most
    frequent length. Of rows that share a vec_id the smallest vector counts. Fewer than k candidates give fewer
    rows; empty tables give empty results. Each true neighbour is missed with a probability of at most about
    1 - ``confidence``.
    """
    spark = session_of(rows)
    usable = stored(_usable(rows, id_column, vector_column), "vectors")
    shape = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    found = "query_id long, vec_id long, score double"
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = shape[0]["d"], shape[0]["n"]
    usable = usable.where(F.size("v") == d)
    most = usable.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()["m"]
    matrix = np.random.default_rng(seed).standard_normal((d + 1, m))
    factor = chi_square_quantile(confidence, m)

    def arrays(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def project(v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))
        return v @ matrix[:d] + lift[:, None] * matrix[d]

    share = min(1.0, SAMPLE / n)
    part = usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v")
    sample = part.toArrow().column("v").combine_chunks()
    cells = build_cells(project(arrays(sample)) if len(sample) else np.zeros((0, m)), max(1, min(MOST_CELLS, -(-n // CELL_ROWS))), m)
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Batches) -> Batches:
        for batch in batches:
            v = arrays(batch.column(1))
            cell = shared.value.of(project(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], names=["vec_id", "v", "cell"])

    index = stored(usable.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, cell long"), "index")
    # Cells that equal or clustered vectors overfill are split by a hash of the id.
    chunks = stored(index.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL_ROWS)).cast("int").alias("chunks")), "chunks")
    blocks = index.join(chunks, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("limit"))

    def visits(batches: Batches) -> Batches:
        """The cells of each query: its own (limit NULL), or all others that the test leaves."""
        for batch in batches:
            v, ids = arrays(batch.column(1)), batch.column(0).to_numpy()
            limit = batch.column(2).to_numpy(zero_copy_only=False)
            zq = v @ matrix[:d]
            first = np.isnan(limit)
            own = shared.value.of(zq)
            for a in range(0, len(ids), 256):
                s = slice(a, a + 256)
                near = shared.value.distances(zq[s])
                ok = near <= factor * limit[s][:, None]
                ok[np.arange(len(ok)), own[s]] = False
                ok[first[s]] = False
                ok[np.flatnonzero(first[s]), own[s][first[s]]] = True
                q, c = np.nonzero(ok)
                q += a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c), pa.array(ids[q]), batch.column(1).take(pa.array(q)), pa.array(limit[q])], names=["cell", "vec_id", "v", "limit"])

    def search(batches: Batches) -> Batches:
        block, ids, vectors, tree = None, [], [], None
        for batch in batches:
            cell, chunk, kind = (batch.column(i).to_numpy() for i in range(3))
            vec, v, limit = batch.column(3).to_numpy(), arrays(batch.column(4)), batch.column(5).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])]))
            out_q, out_id, out_score = [], [], []
            for a, b in zip(change, np.append(change[1:], len(cell))):
                if block != (cell[a], chunk[a]):
                    block, ids, vectors, tree = (cell[a], chunk[a]), [], [], None
                if kind[a] == 0:
                    ids.append(vec[a:b])
                    vectors.append(v[a:b])
                    continue
                if tree is None:
                    every = np.concatenate(vectors)
                    tree = Tree(np.concatenate(ids), every, project(every))
                zq = v[a:b] @ matrix[:d]
                for i in range(a, b):
                    lift = float(v[i] @ v[i]) + most
                    bound = np.inf if np.isnan(limit[i]) else float(limit[i])
                    got, scores = tree.search(int(vec[i]), v[i], zq[i - a], k, lift, bound, factor)
                    out_q.append(np.full(len(got), vec[i]))
                    out_id.append(got)
                    out_score.append(scores)
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_id, out_score)], names=["query_id", "vec_id", "score"])

    def run(queries: DataFrame) -> DataFrame:
        asked = queries.mapInArrow(visits, "cell long, vec_id long, v array<double>, limit double")
        asked = asked.join(chunks, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "vec_id", "v", "limit")
        both = blocks.unionByName(asked).repartition(shuffle_partitions(spark), "cell", "chunk").sortWithinPartitions("cell", "chunk", "kind")
        return both.mapInArrow(search, found)

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = usable.where(is_query(F.col("vec_id"))).select("vec_id", "v")
    first = stored(run(queries.withColumn("limit", F.lit(float("nan")))), "first")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bounded = queries.join(kth, "vec_id", "left").select(
        "vec_id", "v", F.coalesce(F.greatest(norm + F.lit(float(most)) - 2 * F.col("score"), F.lit(0.0)), F.lit(float("inf"))).alias("limit"))
    # Own cells have been searched: queries that still lack k results have no bound and visit all others.
    second = run(bounded.select("vec_id", "v", "limit"))
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
