"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random place within its source. Documents are range-sorted by
(source, place) and written once; the totals per range give each range its starting offset,
so that running sums never need a whole source in one task. The mix takes whole passes over
a source as long as its budget allows and cuts the last pass at the exact word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import key_of_doc, shuffle_partitions, stored, text_of, whole_row

WEIGHTS = (5, 2, 1)
EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
_LEADING = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Sequence[str], group: str | None = None) -> DataFrame:
    """Add ``before_x``: the sum of x over the rows that come earlier in ``order`` (within ``group``).

    The rows are range-partitioned by ``order`` (which starts with the group), numbered by range and
    written; windows then run inside a range, and over one row per range.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [group] if group else []
    per_range = placed.groupBy(*keys, "_range").agg(*[F.sum(x).alias(f"_{x}") for x in sums])
    earlier = (W.partitionBy(group) if group else W.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of"),
        *[F.coalesce(F.sum(f"_{x}").over(earlier), F.lit(0)).alias(f"_from_{x}") for x in sums])
    on = F.col("_range") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return placed.join(offsets, on).withColumns(
        {f"before_{x}": F.col(f"_from_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums}
    ).drop("_range", "_of", *[f"_{k}" for k in keys], *[f"_from_{x}" for x in sums])


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, NULL last, have the weights in turn and share the sum of all sizes by
    weight. No target exceeds ``epochs`` times its source's size; the excess is shared out again by weight.
    Sources ordered by the level at which they reach that limit show where the sharing settles.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = prefix_sums(sources.withColumn("one", F.lit(1).cast("long")), by_name, ["one"])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("limit"))
    by_level = [F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    filled = stored(prefix_sums(ranked, by_level, ["limit", "weight"]), "levels")
    total = filled.agg(F.struct(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))).scalar()
    level = (total["size"] - F.col("before_limit")).cast("double") / (total["weight"] - F.col("before_weight"))
    settled = filled.select(level.alias("level"), (F.col("limit") / F.col("weight")).alias("most")).where("level <= most")
    settled = stored(settled.agg(F.max("level").alias("level")), "level").scalar()
    target = F.least(F.col("limit").cast("double"), settled * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken) per row of ``docs`` (doc_id, text, source).

    ``size`` is the number of words (NULL text: 0), ``target`` the words wanted from the source and ``taken``
    those taken from the row: size for each whole pass, plus what the last pass, cut at the word where the
    rounded target is met, takes of it. The taken words of a source sum to its rounded target. Repeated rows
    are rows of their own; rows without words give nothing; NULL ids and sources are values like others. An
    empty table gives an empty result. Equal input gives equal results in any partitioning.
    """
    place = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of(docs)))
    sized = stored(docs.select(
        "doc_id", "source", F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
        place.alias("place"), F.xxhash64(text_of(docs)).alias("text_hash")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    order = [F.col("source").isNull(), F.col("source"), F.col("place"), F.col("doc_id")]
    placed = prefix_sums(sized, order, ["size"], "source")
    targets = stored(targets.withColumnRenamed("source", "_source"), "targets")
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_size")))
    return placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix as rows of ``docs``: each row as often as it is taken, the last time cut after its last word taken.

    All columns are kept; ``n_chars``, where there is one, follows a cut text. Equal rows are pooled.
    """
    mixed = mix_sources(docs.select("doc_id", "text", "source"), weights, epochs)
    takes = mixed.groupBy(key_of_doc().alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source")).agg(
        F.sum("taken").alias("_taken"), F.max("size").alias("_size")).where("_taken > 0")
    takes = stored(takes, "takes")
    rows = docs.select(whole_row(docs), key_of_doc().alias("doc"), F.xxhash64(text_of(docs)).alias("hash"), F.col("source").alias("of"))
    joined = rows.join(takes, (F.col("doc") == F.col("_id")) & (F.col("hash") == F.col("_hash")) & F.col("of").eqNullSafe(F.col("_source")))
    once = F.row_number().over(W.partitionBy("_id", "_hash", "_source").orderBy("_hash"))
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))
    out = joined.withColumn("n", once).where("n = 1").withColumn("copy", F.explode(copies))
    left = F.col("_taken") - (F.col("copy") - 1) * F.col("_size")
    words = F.slice(F.regexp_extract_all("row.text", F.lit(_LEADING), 0), F.lit(1), left.cast("int"))
    cut = left < F.col("_size")
    changed = {"text": F.when(cut, F.array_join(words, "")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(cut, F.length(changed["text"]).cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


ORACLE = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
   md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 r AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3] AS weight FROM s),
 l AS (SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS most,
   coalesce(sum(3 * source_size) OVER w, 0) AS before_limit, coalesce(sum(weight) OVER w, 0) AS before_weight,
   sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM r
   WINDOW w AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT max(level) AS level FROM (SELECT CAST(total - before_limit AS DOUBLE) / CAST(weights - before_weight AS DOUBLE) AS level, most FROM l) WHERE level <= most),
 t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM l, v),
 c AS (SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_size
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
  + greatest(0, least(size, budget % source_size - before_size)) END AS BIGINT) AS taken FROM c"""
