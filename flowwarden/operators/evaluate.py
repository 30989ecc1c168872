"""Evaluation of classifier and anomaly scores. All reports come from small aggregates of one pass each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import col, divide_or_null
from ..functions.prefix import exact_percentiles, running_totals
from ..schema import BENIGN
from ..session import materialise


def _share(num: Column, den: Column) -> Column:
    """Ratio with zero division giving 0."""
    return F.coalesce(divide_or_null(num, den), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return _share(2.0 * precision * recall, precision + recall)


# ---- classifier

def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts per true and predicted class, and the share of the true class."""
    counts = df.groupBy(col(label).alias("label"), col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("recall_share", F.col("n") / F.sum("n").over(W.partitionBy("label")))


def classification_report(confusion: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro avg and weighted avg."""
    hit = F.col("label") == F.col("predicted")
    sides = confusion.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), F.when(hit, F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hits")),
    )))
    per_class = (
        sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hits")])
        .withColumns({"precision": _share(F.col("hits"), F.col("called")), "recall": _share(F.col("hits"), F.col("support"))})
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )
    none = F.lit(None).cast("double")

    def weighted(c: str) -> Column:
        return _share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)

    rows = per_class.agg(
        F.struct(F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"), _share(F.sum("hits"), F.sum("support")).alias("f1"), F.sum("support").alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("class"), *[weighted(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).alias("w"),
    ).select(F.inline(F.array("a", "m", "w")))
    return per_class.select("class", "precision", "recall", "f1", "support").unionByName(rows)


def weak_classes(report: DataFrame, below: float = 0.70) -> DataFrame:
    averages = ("accuracy", "macro avg", "weighted avg")
    return report.filter(~F.col("class").isin(*averages) & (F.col("f1") < below)).select("class", "f1")


# ---- anomaly scores

def clip_scores(df: DataFrame, score: str = "score", probability: float = 0.999) -> DataFrame:
    """Scores clipped to [0, p99.9] of all scores."""
    limit = materialise(exact_percentiles(df, score, {"p": probability})).select("p").scalar()
    return df.withColumn(score, F.least(F.greatest(col(score), F.lit(0.0)), limit))


def binary_metrics(df: DataFrame, threshold: Column, score: str = "score", label: str = "label", benign: str = BENIGN) -> DataFrame:
    """Precision, recall, F1 of ``score > threshold`` against the attack rows, and the benign error rate."""
    attack = col(label) != benign
    flagged = col(score) > threshold
    counts = df.agg(
        F.count_if(attack & flagged).alias("tp"), F.count_if(~attack & flagged).alias("fp"),
        F.count_if(attack & ~flagged).alias("fn"), F.count_if(~attack & ~flagged).alias("tn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates from columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "benign_fpr": _share(fp, fp + tn),
    }).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def detection_rates(df: DataFrame, threshold: Column, score: str = "score", label: str = "label", benign: str = BENIGN) -> DataFrame:
    """Total, caught and rate per attack class."""
    return (
        df.filter(col(label) != benign).groupBy(col(label).alias("class"))
        .agg(F.count("*").alias("total"), F.count_if(col(score) > threshold).alias("caught"))
        .withColumn("rate", _share(F.col("caught"), F.col("total")))
    )


def cross_model(
    df: DataFrame, threshold: Column, score: str = "score", label: str = "label", predicted: str = "predicted", benign: str = BENIGN
) -> DataFrame:
    """Attacks the classifier called benign, and how many of them the score flags; the NULL class has the totals."""
    missed = col(predicted) == benign
    per_class = df.filter(col(label) != benign).groupBy(col(label).alias("class")).agg(
        F.count("*").alias("attacks"), F.count_if(missed).alias("rf_missed"),
        F.count_if(missed & (col(score) > threshold)).alias("ae_saved"),
    )
    total = per_class.agg(*[F.sum(c).alias(c) for c in ("attacks", "rf_missed", "ae_saved")])
    return per_class.unionByName(total.withColumn("class", F.lit(None).cast("string")))


def detection_table(
    df: DataFrame, thresholds: Mapping[str, Column], watched: str = "Infilteration",
    score: str = "score", label: str = "label", benign: str = BENIGN,
) -> DataFrame:
    """Rates at each named threshold and the rate of one watched class, from one aggregation."""
    attack, seen = col(label) != benign, col(label) == watched
    aggs = []
    for name, t in thresholds.items():
        hit = col(score) > t
        aggs.append(F.struct(
            F.lit(name).alias("name"), F.max(t).alias("threshold"),
            F.count_if(attack & hit).alias("tp"), F.count_if(~attack & hit).alias("fp"),
            F.count_if(attack & ~hit).alias("fn"), F.count_if(~attack & ~hit).alias("tn"),
            _share(F.count_if(seen & hit), F.count_if(seen)).alias("watched_rate"),
        ).alias(name))
    return with_rates(df.agg(*aggs).select(F.inline(F.array(*thresholds))))


BENIGN_PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def benign_thresholds(benign_scores: DataFrame, score: str = "score") -> DataFrame:
    """One row of percentiles of the benign scores, clipped at their p99.9."""
    return materialise(exact_percentiles(clip_scores(benign_scores, score), score, BENIGN_PERCENTILES))


def calibrate_threshold(clean_scores: DataFrame, percentile: float = 99.5, score: str = "score") -> DataFrame:
    """One row: the percentile of the scores of clean flows."""
    return materialise(exact_percentiles(clean_scores, score, {"threshold": percentile / 100.0}))


def _grid(low: Column, high: Column, i: Column, n: int) -> Column:
    """Point i of n evenly spaced points; the last one is exactly ``high``."""
    return F.when(i >= n - 1, high).otherwise(low + i * ((high - low) / F.lit(float(n - 1))))


def _points_below(value: Column, low: Column, high: Column, n: int, strict: bool) -> Column:
    """How many grid points are < value (<= value if not strict).

    The division only gives the neighbourhood; the points around it are compared themselves.
    """
    step = (high - low) / F.lit(float(n - 1))
    near = F.floor(F.coalesce(F.try_divide(value - low, step), F.lit(0.0)))
    base = F.greatest(F.lit(0), F.least(F.lit(n), near - 1)).cast("int")
    out = base
    for k in range(3):
        point = _grid(low, high, base + k, n)
        out = out + F.when((base + k < n) & ((point < value) if strict else (point <= value)), 1).otherwise(0)
    return out


def threshold_sweep(
    df: DataFrame, points: int = 300, score: str = "score", label: str = "label", benign: str = BENIGN
) -> DataFrame:
    """Precision, recall and F1 at evenly spaced thresholds from the lowest to the highest score.

    Each score is put between two grid points once; totals above a threshold are
    then running sums over the grid, so one pass serves all thresholds.
    """
    span = df.agg(F.struct(F.min(col(score)).alias("low"), F.max(col(score)).alias("high")).alias("s"))
    span = materialise(span)
    s = span.select("s").scalar()
    attack = col(label) != benign
    counts = (
        df.withColumn("_s", s)
        .groupBy(_points_below(col(score), F.col("_s.low"), F.col("_s.high"), points, strict=True).alias("cell"))
        .agg(F.count_if(attack).alias("attacks"), F.count_if(~attack).alias("benigns"))
    )
    grid = span.select(F.col("s"), F.explode(F.sequence(F.lit(0), F.lit(points))).alias("cell"))
    upward = W.partitionBy(F.lit(1)).orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy(F.lit(1))
    filled = grid.join(counts, "cell", "left").fillna(0, ["attacks", "benigns"])
    # a score in cell c exceeds the points 0 .. c-1, so point i is exceeded by the cells above i
    sums = filled.select(
        (F.col("cell") - 1).alias("idx"), "s",
        F.sum("attacks").over(upward).alias("tp"), F.sum("benigns").over(upward).alias("fp"),
        F.sum("attacks").over(everything).alias("p"), F.sum("benigns").over(everything).alias("n"),
    ).filter("idx >= 0")
    return with_rates(
        sums.select(
            "idx", _grid(F.col("s.low"), F.col("s.high"), F.col("idx"), points).alias("threshold"),
            "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"),
        )
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row of the highest F1; the lowest threshold wins ties."""
    row = F.struct(*sweep.columns)
    best = F.max_by(row, F.struct("f1", (-F.col("idx")).alias("i")))
    return sweep.agg(best.alias("b")).select("b.*")


def nearest_threshold(points: DataFrame, target: Column, order: str = "idx") -> DataFrame:
    """The row whose threshold is closest to the target; the first in order wins ties."""
    row = F.struct(*points.columns)
    near = F.min_by(row, F.struct(F.abs(F.col("threshold") - target).alias("d"), F.col(order).alias("i")))
    return points.agg(near.alias("b")).select("b.*")


def score_points(df: DataFrame, score: str = "score", label: str = "label", benign: str = BENIGN) -> DataFrame:
    """Per distinct score: cumulative attack (tp) and benign (fp) rows from the highest score down."""
    attack = col(label) != benign
    counts = df.groupBy(col(score).alias("threshold")).agg(
        F.count_if(attack).alias("attacks"), F.count_if(~attack).alias("benigns")
    )
    return running_totals(counts, "threshold", ["attacks", "benigns"], descending=True).select(
        "threshold", "attacks", "benigns", F.col("cum_attacks").alias("tp"), F.col("cum_benigns").alias("fp"),
        F.col("total_attacks").alias("p"), F.col("total_benigns").alias("n"),
    )


def roc_curve(points: DataFrame) -> DataFrame:
    """False and true positive rate at each distinct score used as ``score >= threshold``."""
    return points.select("threshold", _share(F.col("fp"), F.col("n")).alias("fpr"), _share(F.col("tp"), F.col("p")).alias("tpr"))


def precision_recall_curve(points: DataFrame) -> DataFrame:
    return points.select(
        "threshold", _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _share(F.col("tp"), F.col("p")).alias("recall")
    )


def curve_areas(points: DataFrame) -> DataFrame:
    """Trapezoid areas under both curves. The previous point is the cumulative count less the own count."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    tp0, fp0 = tp - F.col("attacks"), fp - F.col("benigns")
    precision = _share(tp, tp + fp)
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    return points.agg(
        _share(F.sum(F.col("benigns") * (tp + tp0) / 2.0), F.max("p").cast("double") * F.max("n")).alias("roc_auc"),
        _share(F.sum(F.col("attacks") * (precision + before) / 2.0), F.max("p").cast("double")).alias("pr_auc"),
    )


def score_histogram(df: DataFrame, bins: int = 100, score: str = "score", label: str = "label", benign: str = BENIGN) -> DataFrame:
    """Equal-width histogram with density for benign and attack rows, each over its own range; last bin closed."""
    grouped = df.select(F.when(col(label) == benign, "benign").otherwise("attack").alias("grp"), col(score).alias("x"))
    ranges = materialise(
        grouped.groupBy("grp").agg(F.min("x").alias("low0"), F.max("x").alias("high0"), F.count("*").alias("total"))
        .select(
            "grp", "total",
            F.when(F.col("low0") == F.col("high0"), F.col("low0") - 0.5).otherwise(F.col("low0")).alias("low"),
            F.when(F.col("low0") == F.col("high0"), F.col("high0") + 0.5).otherwise(F.col("high0")).alias("high"),
        )
    )
    points = bins + 1
    # at most two rows: benign and attack
    placed = grouped.join(F.broadcast(ranges), "grp").withColumn(
        "bin", F.least(F.lit(bins), _points_below(F.col("x"), F.col("low"), F.col("high"), points, strict=False)) - 1
    )
    counts = placed.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    cells = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    return cells.join(counts, ["grp", "bin"], "left").select(
        "grp", "bin", _grid(F.col("low"), F.col("high"), F.col("bin"), points).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / (F.col("total") * width)).alias("density"),
    )
