"""Exact hash-rank sampling: quota sampling per group, stratified split, random rows.

Rows are ordered by an md5 of their key, so a sample is the same in every run.
No group is ever sorted as a whole. Counts per leading hash digits, which
combine on the map side, show the one bucket in which each group's quota ends;
only that bucket (1/65536 of the group by default) is looked at in detail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import row_hash
from ..functions.joins import join_lookup
from ..functions.numeric import col
from ..schema import BENIGN, LABEL
from ..session import materialise

SEED = 42
BUCKET_DIGITS = 4


def _cutoffs(hashed: DataFrame, groups: Sequence[str], quota: DataFrame, digits: int) -> DataFrame:
    """Per group: the hash at which the quota is reached and how many rows of that hash belong to it.

    ``quota`` has the group columns and ``_k``. Groups whose quota covers all
    rows get a NULL hash.
    """
    g = list(groups)
    buckets = hashed.groupBy(*g, F.substring("_hash", 1, digits).alias("_bucket")).agg(F.count("*").alias("_n"))
    running = W.partitionBy(*g).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    cut = (
        join_lookup(buckets.withColumn("_cum", F.sum("_n").over(running)), quota, g, how="inner")
        .filter((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_n") < F.col("_k")))
        .select(*g, F.col("_bucket").alias("_cut_bucket"), (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_need"))
    )
    cut = materialise(cut)
    inside = join_lookup(hashed, cut, g).filter(F.substring("_hash", 1, digits) == F.col("_cut_bucket"))
    copies = inside.groupBy(*g, "_need", "_hash").agg(F.count("*").alias("_copies"))
    ranked = W.partitionBy(*g).orderBy("_hash").rowsBetween(W.unboundedPreceding, 0)
    return (
        copies.withColumn("_cum", F.sum("_copies").over(ranked))
        .filter((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_copies") < F.col("_need")))
        .select(*g, F.col("_hash").alias("_cut_hash"), (F.col("_need") - F.col("_cum") + F.col("_copies")).alias("_take"), "_copies")
    )


def mark_quota(
    df: DataFrame,
    groups: Sequence[str],
    quota: DataFrame,
    keys: Sequence[str] | None = None,
    seed: int = SEED,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add boolean ``selected``: true for exactly ``_k`` rows of each group of ``quota``, lowest hashes first.

    Groups without a quota, or with a quota of all rows, are selected whole only
    where the quota says so; see the callers. Rows with equal keys are copies:
    where the quota ends among copies they are counted, not ranked.
    """
    g = list(groups)
    hashed = df.withColumn("_hash", row_hash(df, keys, seed))
    cutoffs = materialise(_cutoffs(hashed.select(*[col(c) for c in g], "_hash"), g, quota, digits))
    joined = join_lookup(hashed, cutoffs, g, how="left")
    below = F.col("_hash") < F.col("_cut_hash")
    at = F.col("_hash") == F.col("_cut_hash")
    helper = ["_hash", "_cut_hash", "_take", "_copies"]
    if cutoffs.filter("_take < _copies").isEmpty():
        return joined.withColumn("selected", F.coalesce(below | at, F.lit(False))).drop(*helper)
    # The quota of some group ends inside a set of copies: count equal rows and hand out the first _take.
    split = at & (F.col("_take") < F.col("_copies"))
    whole = joined.filter(~F.coalesce(split, F.lit(False))).withColumn("selected", F.coalesce(below | at, F.lit(False)))
    columns = [c for c in joined.columns if c not in helper]
    equal = joined.filter(split).groupBy(*[col(c) for c in columns], "_hash", "_take").agg(F.count("*").alias("_n"))
    order = W.partitionBy(*[col(c) for c in g], "_hash").orderBy(*[col(c) for c in columns]).rowsBetween(W.unboundedPreceding, 0)
    chosen = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_take") - (F.sum("_n").over(order) - F.col("_n"))))
    spread = (
        equal.withColumn("_chosen", chosen)
        .withColumn("selected", F.explode(F.array(F.lit(True), F.lit(False))))
        .withColumn("_times", F.when(F.col("selected"), F.col("_chosen")).otherwise(F.col("_n") - F.col("_chosen")))
        .filter("_times > 0")
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    )
    return whole.select(*[col(c) for c in columns], "selected").unionByName(
        spread.select(*[col(c) for c in columns], "selected")
    )


def cap_benign(
    df: DataFrame,
    cap: int = 100_000,
    file_column: str = "source_file",
    label: str = LABEL,
    benign: str = BENIGN,
    keys: Sequence[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """At most ``cap`` benign rows per file, every attack row."""
    counts = df.filter(col(label) == benign).groupBy(col(file_column)).agg(F.count("*").alias("_n"))
    quota = materialise(counts.filter(F.col("_n") > cap).select(file_column, F.lit(cap).cast("bigint").alias("_k")))
    tagged = df.withColumn("_benign", col(label) == benign)
    quota = quota.withColumn("_benign", F.lit(True))
    over = join_lookup(tagged, quota, [file_column, "_benign"], how="left")
    capped = over.filter(F.col("_k").isNotNull()).drop("_k", "_benign")
    rest = over.filter(F.col("_k").isNull()).drop("_k", "_benign")
    if quota.isEmpty():
        return rest
    chosen = mark_quota(capped, [file_column], quota.drop("_benign"), keys, seed)
    return rest.unionByName(chosen.filter("selected").drop("selected"))


def split_quota(df: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """Test rows per class: floor shares, then the largest remainders until the total fits."""
    counts = df.groupBy(col(label)).agg(F.count("*").alias("_n"))
    shares = counts.select(
        label, "_n",
        F.ceil(F.sum("_n").over(W.partitionBy(F.lit(1))) * F.lit(test_fraction)).alias("_total"),
        F.floor(F.col("_n") * F.lit(test_fraction)).alias("_floor"),
        (F.col("_n") * F.lit(test_fraction) - F.floor(F.col("_n") * F.lit(test_fraction))).alias("_rest"),
    )
    everything = W.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(F.desc("_rest"), col(label)))
    missing = F.col("_total") - F.sum("_floor").over(everything)
    return shares.select(label, (F.col("_floor") + F.when(rank <= missing, 1).otherwise(0)).cast("bigint").alias("_k"))


def mark_test(
    df: DataFrame, label: str = LABEL, test_fraction: float = 0.20, keys: Sequence[str] | None = None, seed: int = SEED
) -> DataFrame:
    """Add boolean ``is_test``: a stratified split, exact per class."""
    quota = materialise(split_quota(df, label, test_fraction)).filter("_k > 0")
    return mark_quota(df, [label], quota, keys, seed).withColumnRenamed("selected", "is_test")


def train_test(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` random rows (all rows where there are fewer)."""
    one = df.withColumn("_all", F.lit(1))
    total = df.count()
    if total <= n:
        return df
    quota = materialise(df.sparkSession.range(1).select(F.lit(1).alias("_all"), F.lit(n).cast("bigint").alias("_k")))
    return mark_quota(one, ["_all"], quota, keys or df.columns, seed).filter("selected").drop("selected", "_all")


def hash_fraction(df: DataFrame, fraction: float, keys: Sequence[str] | None = None, seed: int = SEED) -> Column:
    """True for about ``fraction`` of the rows: one expression, no pass over the data."""
    digits = 8
    limit = format(min(int(fraction * 16**digits), 16**digits - 1), f"0{digits}x")
    return F.substring(row_hash(df, keys, seed), 1, digits) < limit
