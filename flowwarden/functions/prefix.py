"""Running totals and exact percentiles over an ordered table, without a one-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise
from .joins import join_lookup
from .numeric import col


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``cum_x`` (inclusive) and ``total_x`` for every x of ``sums``, per group, in ``order``.

    ``df`` has one row per group and order value. It is range-partitioned and
    written once; totals per range give each range its starting offset; the
    window then runs inside single ranges only.
    """
    g = [col(c) for c in groups]
    key = F.desc(order) if descending else F.asc(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(n, *g, key).withColumn("_range", F.spark_partition_id()))
    per_range = placed.groupBy(*g, "_range").agg(*[F.sum(x).alias(f"_sum_{x}") for x in sums])
    whole = W.partitionBy(*g) if groups else W.partitionBy(F.lit(1))
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *g, "_range",
        *[F.coalesce(F.sum(f"_sum_{x}").over(before), F.lit(0)).alias(f"_before_{x}") for x in sums],
        *[F.sum(f"_sum_{x}").over(whole).alias(f"total_{x}") for x in sums],
    )
    inside = W.partitionBy(*g, "_range").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return (
        join_lookup(placed, offsets, [*groups, "_range"])
        .withColumns({f"cum_{x}": F.col(f"_before_{x}") + F.sum(x).over(inside) for x in sums})
        .drop("_range", *[f"_before_{x}" for x in sums])
    )


#: Values of a bracket lie at most so far from the wanted place, as a share of the group.
BRACKET = 1e-4
#: Up to so many cells the running totals of all groups fit plain windows; beyond, they are taken range by range.
WINDOW_ROWS = 1_000_000


def exact_percentiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], groups: Sequence[str] = (), bracket: float = BRACKET,
) -> DataFrame:
    """Percentiles with linear interpolation, one row per group, one column per entry of ``probabilities``.

    Selection, not sorting: a sketch gives two values on either side of each wanted place, a second pass counts rows
    between the brackets without their values and rows inside them by value, and only these few cells are ranked. A place
    that a sketch has missed is found by ranking all distinct values. NULL and NaN are ignored.
    """
    g = [col(c) for c in groups]
    valid = df.filter(col(value).isNotNull() & ~F.isnan(col(value))).select(*g, col(value).cast("double").alias("_value"))
    wanted = sorted({p for p in probabilities.values()})
    edges = sorted({min(max(p + d, 0.0), 1.0) for p in wanted for d in (-2 * bracket, 2 * bracket)})
    sketch = F.percentile_approx("_value", edges, round(1 / bracket)).alias("_edges")
    bounds = materialise((valid.groupBy(*groups) if groups else valid).agg(sketch).where("_edges IS NOT NULL"))
    placed = join_lookup(valid, bounds, groups) if groups else valid.withColumn("_edges", bounds.select("_edges").scalar())
    at = {p: (edges.index(min(max(p - 2 * bracket, 0.0), 1.0)), edges.index(min(max(p + 2 * bracket, 0.0), 1.0))) for p in wanted}
    v, edge = F.col("_value"), F.col("_edges")
    inside = reduce(lambda a, b: a | b, [(v >= edge[low]) & (v <= edge[high]) for low, high in at.values()])
    below = reduce(lambda a, b: a + b, [(v > edge[k]).cast("int") for k in range(len(edges))])
    cells = placed.groupBy(*groups, F.when(inside, v).alias("_own"), F.when(~inside, below).alias("_cell")).agg(
        F.count("*").alias("_n"), F.min(v).alias("_value"), F.max(v).alias("_most"))
    ranked = materialise(_ranked(materialise(cells), groups))
    missed = [F.max((F.col("_most") > v) & _covers(p, whole)).alias("m") for p in wanted for whole in (F.floor, F.ceil)]
    if ranked.agg(*[m.alias(f"m{k}") for k, m in enumerate(missed)]).select(F.greatest(*[F.coalesce(f"m{k}", F.lit(False)) for k in range(len(missed))], F.lit(False))).first()[0]:
        counts = valid.groupBy(*groups, "_value").agg(F.count("*").alias("_n"))
        ranked = running_totals(counts, "_value", ["_n"], groups)
    aggs = []
    for name, p in probabilities.items():
        low, high = (F.max(F.when(_covers(p, whole), v)) for whole in (F.floor, F.ceil))
        aggs.append((low + (high - low) * F.max(_position(p) - F.floor(_position(p)))).alias(name))
    return ranked.groupBy(*g).agg(*aggs) if groups else ranked.agg(*aggs)


def _ranked(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    if cells.limit(WINDOW_ROWS + 1).count() > WINDOW_ROWS:
        return running_totals(cells, "_value", ["_n"], groups)
    whole = W.partitionBy(*[col(c) for c in groups]) if groups else W.partitionBy(F.lit(1))
    upto = whole.orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumns({"cum__n": F.sum("_n").over(upto), "total__n": F.sum("_n").over(whole)})


def _position(p: float):
    """The place of a percentile, counted from 0, between whole places."""
    return F.lit(p) * (F.col("total__n") - 1)


def _covers(p: float, whole):
    rank = whole(_position(p))
    return (F.col("cum__n") - F.col("_n") <= rank) & (rank <= F.col("cum__n") - 1)


def column_percentiles(
    df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], name: str = "column_name", bracket: float = BRACKET,
) -> DataFrame:
    """As :func:`exact_percentiles` for each of ``columns``, one row per column that has a value, without turning columns into rows.

    All sketches come from one pass, all counts below the brackets from a second; only values inside a bracket are
    exchanged. What comes to the driver is bounded by the number of columns and percentiles.
    """
    spark = df.sparkSession
    one = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    wanted = sorted(set(probabilities.values()))
    ends = [min(max(p + d, 0.0), 1.0) for p in wanted for d in (-2 * bracket, 2 * bracket)]
    found = one.agg(*[F.percentile_approx(f"c{i}", ends, round(1 / bracket)).alias(f"e{i}") for i in range(len(columns))]).first()
    spans = [(i, k, float(found[i][2 * k]), float(found[i][2 * k + 1])) for i in range(len(columns)) if found[i] is not None for k in range(len(wanted))]
    if not spans:
        return spark.createDataFrame([], f"`{name}` string, " + ", ".join(f"`{n}` double" for n in probabilities))
    counts = one.agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.count_if(F.col(f"c{i}") < low).alias(f"b{i}_{k}") for i, k, low, _ in spans],
    ).first()
    value = {i: F.col(f"c{i}") for i in range(len(columns))}
    hits = F.array(*[F.when((value[i] >= low) & (value[i] <= high), F.struct(F.lit(i).alias("_i"), F.lit(k).alias("_k"), value[i].alias("_value")))
                     for i, k, low, high in spans])
    cells = one.select(F.inline(F.array_compact(hits))).groupBy("_i", "_k", "_value").agg(F.count("*").alias("_n"))
    ranked = _ranked(materialise(cells), ["_i", "_k"])
    place = [(i, k, wanted[k] * (counts[f"n{i}"] - 1), counts[f"b{i}_{k}"]) for i, k, *_ in spans]
    places = spark.createDataFrame(place, "_i int, _k int, _at double, _below long")
    chosen = [F.max(F.when((F.col("cum__n") - F.col("_n") <= r) & (r < F.col("cum__n")), F.col("_value")))
              for r in (whole("_at") - F.col("_below") for whole in (F.floor, F.ceil))]
    low, high = chosen
    at = F.max("_at")
    picked = materialise(ranked.join(F.broadcast(places), ["_i", "_k"]).groupBy("_i", "_k").agg(low.alias("low"), high.alias("high"), (at - F.floor(at)).alias("part")))
    labels = F.array(*[F.lit(c) for c in columns])
    if picked.filter("low IS NOT NULL AND high IS NOT NULL").count() < len(spans):  # a sketch missed its place
        values = F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), v.alias("_value")) for i, v in value.items()]))
        return exact_percentiles(one.select(values), "_value", probabilities, ["_i"], bracket).select(labels[F.col("_i")].alias(name), *probabilities)
    result = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return picked.groupBy("_i").agg(
        *[F.max(F.when(F.col("_k") == wanted.index(p), result)).alias(n) for n, p in probabilities.items()]
    ).select(labels[F.col("_i")].alias(name), *probabilities)


def sketch_percentiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], groups: Sequence[str] = (), accuracy: int = 100_000
) -> DataFrame:
    """Approximate percentiles from one mergeable sketch per group, for data too large to sort."""
    names = list(probabilities)
    sketch = F.percentile_approx(col(value), [probabilities[n] for n in names], accuracy)
    grouped = df.groupBy(*[col(c) for c in groups]) if groups else df
    out = grouped.agg(sketch.alias("_p"))
    return out.select(*[col(c) for c in groups], *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
