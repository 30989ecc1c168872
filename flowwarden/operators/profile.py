"""Data profiling: class counts, missing values, moments, correlation, constant columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.numeric import col, divide_or_null, finite_or_null
from ..functions.prefix import column_percentiles, sketch_percentiles
from ..schema import BENIGN, LABEL
from ..session import materialise


def column_report(
    df: DataFrame, columns: Sequence[str], measures: Mapping[str, Callable[[Column], Column]], name: str = "column_name"
) -> DataFrame:
    """One row per column with the given aggregates, from one pass over the data."""
    one = df.agg(*[
        F.struct(*[fn(col(c)).alias(m) for m, fn in measures.items()]).alias(f"_c{i}") for i, c in enumerate(columns)
    ])
    rows = [
        F.struct(F.lit(c).alias(name), *[F.col(f"_c{i}.{m}").alias(m) for m in measures]) for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def unpivot_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (column_name, value) of numeric columns."""
    wide = df.select(*[col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([], [col(c) for c in columns], "column_name", "value")


def class_counts(df: DataFrame, label: str = LABEL, file_column: str = "source_file") -> DataFrame:
    """Rows and percent per file and class; NULL file rows are the global counts."""
    counts = df.groupBy(col(file_column).alias("file"), col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("file"), "label", "n")
    both = counts.unionByName(totals)
    return both.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy("file")))


def sampling_projection(
    df: DataFrame, cap: int = 100_000, label: str = LABEL, file_column: str = "source_file", benign: str = BENIGN
) -> DataFrame:
    """Per file: benign rows, benign rows kept under the cap, attack rows; a NULL file row has the totals."""
    is_benign = col(label) == benign
    files = df.groupBy(col(file_column).alias("file")).agg(
        F.count_if(is_benign).alias("benign"), F.count_if(~is_benign).alias("attack")
    ).withColumn("taken", F.least(F.col("benign"), F.lit(cap)))
    total = files.agg(*[F.sum(c).alias(c) for c in ("benign", "attack", "taken")]).withColumn("file", F.lit(None).cast("string"))
    return files.unionByName(total).withColumn(
        "attack_ratio", divide_or_null(F.col("attack"), F.col("attack") + F.col("taken"))
    )


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per data type, from the schema alone."""
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema])
    one = df.sparkSession.range(1).select(F.explode(types).alias("type"))
    return one.groupBy("type").agg(F.count("*").alias("n_columns"))


def text_profile(df: DataFrame, label: str = LABEL, samples: int = 5) -> DataFrame:
    """Distinct count and the first sample values (in sort order) of every text column but the label."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != label]
    values = (
        df.select(*[col(c) for c in columns]).unpivot([], [col(c) for c in columns], "column_name", "value")
        .filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    )
    # rank <= k is cut down before the shuffle, so no task sees all values of a column
    first = values.withColumn("_r", F.row_number().over(W.partitionBy("column_name").orderBy("value"))).filter(F.col("_r") <= samples)
    shown = first.groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return values.groupBy("column_name").agg(F.count("*").alias("n_distinct")).join(shown, "column_name")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing (NULL or NaN) and infinite cells per column with percents."""
    inf = F.lit(float("inf"))

    def number(c: Column) -> Column:
        return c.cast("double")

    report = column_report(df, columns, {
        "n_rows": lambda c: F.count("*"),
        "n_missing": lambda c: F.count_if(c.isNull() | F.isnan(number(c))),
        "n_inf": lambda c: F.count_if(F.abs(number(c)) == inf),
    })
    pct = lambda c: F.coalesce(divide_or_null(F.lit(100.0) * F.col(c), F.col("n_rows")), F.lit(0.0))
    return report.select(
        "column_name", "n_missing", "n_inf", pct("n_missing").alias("missing_pct"), pct("n_inf").alias("inf_pct")
    )


def missing_totals(profile: DataFrame) -> DataFrame:
    return profile.agg(F.sum("n_missing").alias("missing_cells"), F.sum("n_inf").alias("inf_cells"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: Sequence[str], quartiles: bool = True, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of the finite values of each column."""
    report = column_report(df, columns, {
        "n": lambda c: F.count(finite_or_null(c)),
        "mean": lambda c: F.avg(finite_or_null(c)),
        "std": lambda c: F.stddev_samp(finite_or_null(c)),
        "min": lambda c: F.min(finite_or_null(c)),
        "max": lambda c: F.max(finite_or_null(c)),
    })
    if not quartiles:
        return report
    return report.join(_percentiles(df, columns, QUARTILES, exact), "column_name", "left")


def _percentiles(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], exact: bool) -> DataFrame:
    finite = df.select(*[finite_or_null(col(c)).alias(c) for c in columns])
    if exact:
        return column_percentiles(finite, columns, probabilities)
    return sketch_percentiles(unpivot_values(finite, columns), "value", probabilities, ["column_name"])


def outlier_profile(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """p0.1, p99.9, minimum, maximum and |max / p99.9| of the finite values of each column."""
    report = column_report(df, columns, {
        "min": lambda c: F.min(finite_or_null(c)), "max": lambda c: F.max(finite_or_null(c)),
    })
    tails = _percentiles(df, columns, {"p001": 0.001, "p999": 0.999}, exact)
    return report.join(tails, "column_name", "left").withColumn(
        "max_ratio", F.abs(divide_or_null(F.col("max"), F.col("p999")))
    )


def mean_ratio(df: DataFrame, columns: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Means of two row sets side by side and |first / second|, NULL for a zero denominator."""
    report = column_report(df, columns, {
        "first_mean": lambda c: F.avg(F.when(first, finite_or_null(c))),
        "second_mean": lambda c: F.avg(F.when(second, finite_or_null(c))),
    })
    return report.withColumn("ratio", F.abs(divide_or_null(F.col("first_mean"), F.col("second_mean"))))


def top_rows(df: DataFrame, by: str, k: int, name: str = "column_name", descending: bool = True) -> DataFrame:
    """First ``k`` rows by a measure, missing values last, the name breaks ties."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(order, F.asc(name)).limit(k)


def top_variance(df: DataFrame, columns: Sequence[str], k: int = 30) -> DataFrame:
    return top_rows(column_report(df, columns, {"variance": lambda c: F.var_samp(finite_or_null(c))}), "variance", k)


# ---- constant columns

def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct non-missing values per column."""
    values = unpivot_values(df, columns).filter("value IS NOT NULL AND NOT isnan(value)")
    return values.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def low_cardinality_columns(df: DataFrame, columns: Sequence[str], limit: int = 5) -> DataFrame:
    """Columns with at most ``limit`` distinct values: n_distinct and the value counts.

    A one-pass sketch first removes columns that certainly have more: with
    ``limit`` values at most ``limit`` registers of the sketch are set, so its
    estimate stays below twice the limit.
    """
    sketch = column_report(df, columns, {"estimate": lambda c: F.approx_count_distinct(c)}).collect()
    narrow = [r["column_name"] for r in sketch if r["estimate"] <= 2 * limit]
    if not narrow:
        empty = "column_name string, n_distinct bigint, value_counts array<struct<value:double,n:bigint>>"
        return df.sparkSession.createDataFrame([], empty)
    counts = distinct_counts(df, narrow)
    found = counts.groupBy("column_name").agg(
        F.count("*").alias("n_distinct"), F.sort_array(F.collect_list(F.struct("value", "n"))).alias("value_counts")
    )
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in narrow])).alias("column_name"))
    return names.join(found, "column_name", "left").withColumn(
        "n_distinct", F.coalesce("n_distinct", F.lit(0))
    ).filter(F.col("n_distinct") <= limit)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one distinct non-missing value: minimum equals maximum."""
    report = column_report(df, columns, {
        "low": lambda c: F.min(F.nanvl(c.cast("double"), F.lit(None))),
        "high": lambda c: F.max(F.nanvl(c.cast("double"), F.lit(None))),
    })
    return [r["column_name"] for r in report.filter("low IS NULL OR low = high").orderBy("column_name").collect()]


def drop_constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


# ---- correlation

def _pair_sums(shift: list[float]):
    """Per batch the sums that the correlation of each column pair needs, over rows where both have a value."""
    def run(batches):
        total = None
        for batch in batches:
            valid = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            x = np.stack([c.fill_null(s).to_numpy(zero_copy_only=False) for c, s in zip(batch.columns, shift)], axis=1) - np.array(shift)
            sums = np.stack([valid.T @ valid, x.T @ valid, valid.T @ x, (x * x).T @ valid, valid.T @ (x * x), x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *_SUMS])

    return run


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of all column pairs i <= j, for any number of columns, in one pass over the rows.

    Each pair uses the rows where both values are there; r is NULL where one of them is constant in those rows.
    Values are taken relative to the column's minimum, so that constants give exact zeros.
    """
    one = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    low = one.agg(*[F.min(c).alias(c) for c in one.columns]).first()
    shift = [0.0 if x is None or x != x or abs(x) == float("inf") else float(x) for x in low]
    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    summed = one.mapInArrow(_pair_sums(shift), schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    n, sx, sy, sxx, syy, sxy = (F.col(s) for s in _SUMS)
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    r = F.when((n > 0) & ~(vx <= 1e-12 * sxx) & ~(vy <= 1e-12 * syy), (sxy - sx * sy / n) / F.sqrt(vx * vy))
    name = F.array(*[F.lit(c) for c in columns])
    safe = summed.withColumn("n", F.when(n > 0, n))
    return safe.select("i", "j", name[F.col("i")].alias("feat_a"), name[F.col("j")].alias("feat_b"), r.alias("r"))


def high_correlations(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs with |r| >= threshold; the member less correlated with all columns is the drop candidate.

    Means are compared at 12 decimals; a tie drops the later column. The result
    is bounded by the number of columns and written once, later steps read it often.
    """
    both = pairs.select("feat_a", "r").unionByName(
        pairs.filter("i <> j").select(F.col("feat_b").alias("feat_a"), "r")
    )
    means = both.groupBy(F.col("feat_a").alias("feat")).agg(F.round(F.avg(F.abs("r")), 12).alias("mean_r"))
    a = means.select(F.col("feat").alias("feat_a"), F.col("mean_r").alias("mean_a"))
    b = means.select(F.col("feat").alias("feat_b"), F.col("mean_r").alias("mean_b"))
    return materialise(
        pairs.filter((F.col("i") < F.col("j")) & (F.abs("r") >= threshold))
        .join(a, "feat_a").join(b, "feat_b")
        .select(
            "i", "j", "feat_a", "feat_b", F.round("r", 6).alias("correlation"),
            F.when(F.col("mean_b") <= F.col("mean_a"), F.col("feat_b")).otherwise(F.col("feat_a")).alias("drop_candidate"),
        )
    )


def redundant_columns(high: DataFrame) -> DataFrame:
    """Greedy choice over the pairs by falling |r|: a pair with a dropped member is settled.

    The pair table is bounded by the number of columns, not by the data.
    """
    ordered = high.agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.abs("correlation")).alias("o"), "j", "i", "feat_a", "feat_b", "drop_candidate"
        ))).alias("pairs")
    )

    def step(dropped: Column, p: Column) -> Column:
        settled = F.array_contains(dropped, p["feat_a"]) | F.array_contains(dropped, p["feat_b"])
        return F.when(settled, dropped).otherwise(F.array_append(dropped, p["drop_candidate"]))

    folded = F.aggregate("pairs", F.array().cast("array<string>"), step)
    return ordered.select(F.explode(F.sort_array(folded)).alias("dropped"))


def pruned_features(features: DataFrame, dropped: DataFrame) -> DataFrame:
    """The feature list without the dropped columns."""
    return features.join(dropped, features["feature"] == dropped["dropped"], "left_anti")


def pruning_summary(features: DataFrame, high: DataFrame, dropped: DataFrame, threshold: float = 0.95) -> DataFrame:
    n = features.agg(F.count("*")).scalar()
    n_dropped = dropped.agg(F.count("*")).scalar()
    return high.agg(F.count("*").alias("n_pairs_found")).select(
        F.lit(threshold).alias("threshold"), n.alias("n_original_features"),
        (n - n_dropped).alias("n_pruned_features"), n_dropped.alias("n_dropped"), "n_pairs_found",
    )


def class_weights(df: DataFrame, label: str = LABEL, cap: float = 20.0) -> DataFrame:
    """Balanced weight n / (classes * count) per class, capped."""
    counts = df.groupBy(col(label).alias("label")).agg(F.count("*").alias("n"))
    everything = W.partitionBy(F.lit(1))
    return counts.withColumn("raw_weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).withColumn(
        "weight", F.least("raw_weight", F.lit(cap))
    )
