"""Queries over the evaluation operators. ``rf_label`` and ``ae_score`` stand in for model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prefix import exact_percentiles
from ..operators.evaluate import (
    benign_thresholds, best_threshold, binary_metrics, calibrate_threshold, classification_report, clip_scores,
    confusion_matrix, cross_model, curve_areas, detection_rates, detection_table, nearest_threshold,
    precision_recall_curve, roc_curve, score_histogram, score_points, threshold_sweep, weak_classes,
)
from ..plans.offline import evaluate, save_evaluation
from ..schema import LABEL
from ..session import scratch_path
from .registry import query
from .views import WITH_FLOWS, flows

_S = f"{WITH_FLOWS}, s AS (SELECT label, rf_label AS predicted, ae_score AS score, label <> 'Benign' AS attack FROM flows_v)"
_CLIP = f"{_S}, q AS (SELECT quantile_cont(score, 0.999) AS p FROM s), e AS (SELECT label, predicted, attack, least(greatest(score, 0), p) AS score FROM s, q)"


def scores(spark, sf_dir):
    return flows(spark, sf_dir).select("label", F.col("rf_label").alias("predicted"), F.col("ae_score").alias("score"))


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _points_rounded(df, *rates):
    # scores have seven decimals: rounding the threshold at eight meets no ties
    return _r(_r(df, *rates), "threshold", digits=8)


_RATES = ("precision", "recall", "benign_fpr", "f1")


def _rates_sql(tp: str, fp: str, fn: str, tn: str) -> str:
    return (
        f"round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS recall, "
        f"round(coalesce({fp} / nullif({fp} + {tn}, 0), 0), 6) AS benign_fpr, round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS f1"
    )


@query("a11_confusion_matrix", f"""{_S}, c AS (SELECT label, predicted, count(*) AS n FROM s GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY label), 6) AS recall_share FROM c""")
def a11(spark, sf_dir):
    return _r(confusion_matrix(scores(spark, sf_dir)), "recall_share")


_REPORT = f"""{_S}, cls AS (SELECT label AS class FROM s UNION SELECT predicted FROM s),
 b AS (SELECT class, (SELECT count(*) FROM s WHERE label = class) AS support, (SELECT count(*) FROM s WHERE predicted = class) AS called,
   (SELECT count(*) FROM s WHERE label = class AND predicted = class) AS hits FROM cls),
 m AS (SELECT *, coalesce(hits / nullif(called, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM b),
 k AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support, hits FROM m),
 report AS (SELECT class, precision, recall, f1, support FROM k
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support) FROM k
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM k
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM k)"""


@query("a12_class_report", f"{_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report")
def a12(spark, sf_dir):
    return _r(classification_report(confusion_matrix(scores(spark, sf_dir))), "precision", "recall", "f1")


@query("a12_weak_classes", f"{_REPORT} SELECT class, round(f1, 6) AS f1 FROM report WHERE f1 < 0.7 AND class NOT IN ('accuracy','macro avg','weighted avg')")
def a12_weak(spark, sf_dir):
    return _r(weak_classes(classification_report(confusion_matrix(scores(spark, sf_dir)))), "f1")


_COUNTS = "count(*) FILTER (attack AND score > {t}) AS tp, count(*) FILTER (NOT attack AND score > {t}) AS fp, count(*) FILTER (attack AND score <= {t}) AS fn, count(*) FILTER (NOT attack AND score <= {t}) AS tn"


@query("a13_binary_metrics", f"{_S}, c AS (SELECT {_COUNTS.format(t=2.0)} FROM s) SELECT *, {_rates_sql('tp', 'fp', 'fn', 'tn')} FROM c")
def a13(spark, sf_dir):
    return _r(binary_metrics(scores(spark, sf_dir), F.lit(2.0)), *_RATES)


@query("a14_detection_rates", f"{_S} SELECT label AS class, count(*) AS total, count(*) FILTER (score > 2) AS caught, round(count(*) FILTER (score > 2) / count(*), 6) AS rate FROM s WHERE attack GROUP BY label")
def a14(spark, sf_dir):
    return _r(detection_rates(scores(spark, sf_dir), F.lit(2.0)), "rate")


@query("a15_cross_model", f"""{_S} SELECT label AS class, count(*) AS attacks, count(*) FILTER (predicted = 'Benign') AS rf_missed,
  count(*) FILTER (predicted = 'Benign' AND score > 2) AS ae_saved FROM s WHERE attack GROUP BY ROLLUP (label)""")
def a15(spark, sf_dir):
    return cross_model(scores(spark, sf_dir), F.lit(2.0))


@query("p19_clip_scores", f"{_CLIP} SELECT label, round(score, 8) AS score, count(*) AS n FROM e GROUP BY ALL")
def p19(spark, sf_dir):
    return clip_scores(scores(spark, sf_dir)).groupBy("label", F.round("score", 8).alias("score")).agg(F.count("*").alias("n"))


_LEVELS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995, "p999": 0.999}


@query("a08_percentiles", f"{_S} SELECT label, {', '.join(f'round(quantile_cont(score, {p}), 6) AS {n}' for n, p in _LEVELS.items())} FROM s GROUP BY label")
def a08(spark, sf_dir):
    return _r(exact_percentiles(scores(spark, sf_dir), "score", _LEVELS, ["label"]), *_LEVELS)


_BENIGN_T = """bq AS (SELECT quantile_cont(score, 0.999) AS p FROM s WHERE NOT attack),
 bt AS (SELECT quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, quantile_cont(x, 0.999) AS p999
   FROM (SELECT least(greatest(score, 0), p) AS x FROM s, bq WHERE NOT attack))"""
_BNAMES = ("p50", "p90", "p95", "p99", "p999")


@query("m09_benign_thresholds", f"{_S}, {_BENIGN_T} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in _BNAMES)} FROM bt")
def m09(spark, sf_dir):
    return _r(benign_thresholds(scores(spark, sf_dir).filter("label = 'Benign'")), *_BNAMES)


@query("m08_calibrate_threshold", f"{_S} SELECT round(quantile_cont(score, 0.995), 6) AS threshold FROM s WHERE NOT attack")
def m08(spark, sf_dir):
    return _r(calibrate_threshold(scores(spark, sf_dir).filter("label = 'Benign'")), "threshold")


@query("a16_detection_table", f"""{_CLIP}, {_BENIGN_T}, t AS (UNPIVOT bt ON p50, p90, p95, p99, p999 INTO NAME name VALUE threshold),
 c AS (SELECT name, threshold, count(*) FILTER (attack AND score > threshold) AS tp, count(*) FILTER (NOT attack AND score > threshold) AS fp,
   count(*) FILTER (attack AND score <= threshold) AS fn, count(*) FILTER (NOT attack AND score <= threshold) AS tn,
   round(count(*) FILTER (label = 'Infilteration' AND score > threshold) / count(*) FILTER (label = 'Infilteration'), 6) AS watched_rate FROM e, t GROUP BY ALL)
SELECT name, round(threshold, 6) AS threshold, tp, fp, fn, tn, watched_rate, {_rates_sql('tp', 'fp', 'fn', 'tn')} FROM c""")
def a16(spark, sf_dir):
    df = scores(spark, sf_dir)
    limits = benign_thresholds(df.filter("label = 'Benign'")).agg(F.struct(*[F.max(n).alias(n) for n in _BNAMES])).scalar()
    return _r(detection_table(clip_scores(df), {n: limits[n] for n in _BNAMES}), "threshold", "watched_rate", *_RATES)


_SWEEP = f"""{_CLIP}, r AS (SELECT min(score) AS lo, max(score) AS hi FROM e),
 g AS (SELECT i AS idx, CASE WHEN i = 299 THEN hi ELSE lo + i * ((hi - lo) / 299.0E0) END AS threshold FROM r, (SELECT unnest(range(300)) AS i)),
 w AS (SELECT idx, threshold, count(*) FILTER (attack AND score > threshold) AS tp, count(*) FILTER (NOT attack AND score > threshold) AS fp,
   count(*) FILTER (attack AND score <= threshold) AS fn, count(*) FILTER (NOT attack AND score <= threshold) AS tn FROM e, g GROUP BY ALL),
 f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1x FROM w)"""


@query("a17_threshold_sweep", f"{_SWEEP} SELECT idx, round(threshold, 6) AS threshold, tp, fp, fn, tn, {_rates_sql('tp', 'fp', 'fn', 'tn')} FROM f")
def a17(spark, sf_dir):
    return _r(threshold_sweep(clip_scores(scores(spark, sf_dir))), "threshold", *_RATES)


@query("a17_best_threshold", f"{_SWEEP} SELECT idx, round(threshold, 6) AS threshold, round(f1x, 6) AS f1 FROM f ORDER BY round(f1x, 9) DESC, idx LIMIT 1")
def a17_best(spark, sf_dir):
    sweep = threshold_sweep(clip_scores(scores(spark, sf_dir)))
    return _r(best_threshold(sweep.withColumn("f1", F.round("f1", 9))).select("idx", "threshold", "f1"), "threshold", "f1")


@query("t03_nearest_threshold", f"{_SWEEP} SELECT idx, round(threshold, 6) AS threshold, round(f1x, 6) AS f1 FROM f ORDER BY abs(threshold - 2.0), idx LIMIT 1")
def t03(spark, sf_dir):
    sweep = threshold_sweep(clip_scores(scores(spark, sf_dir)))
    return _r(nearest_threshold(sweep, F.lit(2.0)).select("idx", "threshold", "f1"), "threshold", "f1")


_POINTS = f"""{_CLIP}, c AS (SELECT score AS threshold, count(*) FILTER (attack) AS a, count(*) FILTER (NOT attack) AS b FROM e GROUP BY score),
 pts AS (SELECT *, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS p, sum(b) OVER () AS n FROM c WINDOW w AS (ORDER BY threshold DESC))"""


@query("w02_roc_curve", f"{_POINTS} SELECT round(threshold, 8) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM pts")
def w02(spark, sf_dir):
    return _points_rounded(roc_curve(score_points(clip_scores(scores(spark, sf_dir)))), "fpr", "tpr")


@query("w03_precision_recall_curve", f"{_POINTS} SELECT round(threshold, 8) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM pts")
def w03(spark, sf_dir):
    return _points_rounded(precision_recall_curve(score_points(clip_scores(scores(spark, sf_dir)))), "precision", "recall")


@query("w02_w03_areas", f"""{_POINTS}, l AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY threshold DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY threshold DESC) AS fp0 FROM pts)
SELECT round(sum((fp - fp0) / n * (tp + tp0) / p / 2), 6) AS roc_auc,
  round(sum((tp - tp0) / p * (tp / (tp + fp) + CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE 1 END) / 2), 6) AS pr_auc FROM l""")
def areas(spark, sf_dir):
    return _r(curve_areas(score_points(clip_scores(scores(spark, sf_dir)))), "roc_auc", "pr_auc")


@query("t03_roc_operating_point", f"{_POINTS} SELECT round(threshold, 8) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM pts ORDER BY abs(threshold - 2.0), threshold LIMIT 1")
def t03_roc(spark, sf_dir):
    curve = roc_curve(score_points(clip_scores(scores(spark, sf_dir))))
    return _points_rounded(nearest_threshold(curve, F.lit(2.0), "threshold"), "fpr", "tpr")


@query("a21_histogram", f"""{_CLIP}, gr AS (SELECT CASE WHEN attack THEN 'attack' ELSE 'benign' END AS grp, score FROM e),
 r AS (SELECT grp, min(score) AS lo, max(score) AS hi, count(*) AS total FROM gr GROUP BY grp),
 b AS (SELECT grp, CAST(i AS INT) AS bin, lo, hi, total, lo + i * ((hi - lo) / 100.0E0) AS l, CASE WHEN i = 99 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 100.0E0) END AS u FROM r, (SELECT unnest(range(100)) AS i)),
 h AS (SELECT b.grp, bin, l, lo, hi, total, count(score) AS n FROM b LEFT JOIN gr ON gr.grp = b.grp AND score >= l AND (score < u OR (bin = 99 AND score <= u)) GROUP BY ALL)
SELECT grp, bin, round(l, 6) AS left_edge, n, round(n / (total * ((hi - lo) / 100.0E0)), 6) AS density FROM h""")
def a21(spark, sf_dir):
    return _r(score_histogram(clip_scores(scores(spark, sf_dir))), "left_edge", "density")


_ACTIVE = "round(coalesce({a} / nullif({b}, 0), 0), 6)"


@query("e04_evaluation_summary", f"""{_POINTS}, {_REPORT.removeprefix(_S).lstrip(", ")},
 l AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY threshold DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY threshold DESC) AS fp0 FROM pts),
 ar AS (SELECT round(sum((fp - fp0) / n * (tp + tp0) / p / 2), 6) AS roc_auc,
  round(sum((tp - tp0) / p * (tp / (tp + fp) + CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE 1 END) / 2), 6) AS pr_auc FROM l),
 ac AS (SELECT {_COUNTS.format(t=2.0)} FROM e)
SELECT (SELECT round(f1, 6) FROM report WHERE class = 'accuracy') AS accuracy, (SELECT round(f1, 6) FROM report WHERE class = 'macro avg') AS macro_f1,
  (SELECT round(f1, 6) FROM report WHERE class = 'weighted avg') AS weighted_f1,
  (SELECT count(*) FROM report WHERE f1 < 0.7 AND class NOT IN ('accuracy', 'macro avg', 'weighted avg')) AS n_weak_classes, roc_auc, pr_auc, 2.0E0 AS active_threshold,
  {_ACTIVE.format(a="tp", b="tp + fp")} AS active_precision, {_ACTIVE.format(a="tp", b="tp + fn")} AS active_recall,
  {_ACTIVE.format(a="fp", b="fp + tn")} AS active_benign_fpr, {_ACTIVE.format(a="2 * tp", b="2 * tp + fp + fn")} AS active_f1 FROM ar, ac""")
def e04(spark, sf_dir):
    """The whole evaluation job at a threshold set by hand: all reports stored, the stored summary read back."""
    root = scratch_path(spark, "evaluation")
    outputs = flows(spark, sf_dir).select(F.col("label").alias(LABEL), "rf_label", "ae_score")
    save_evaluation(evaluate(outputs, threshold=2.0), root)
    columns = ("accuracy", "macro_f1", "weighted_f1", "roc_auc", "pr_auc", "active_threshold",
               *[f"active_{c}" for c in ("precision", "recall", "benign_fpr", "f1")])
    schema = "n_weak_classes long, " + ", ".join(f"{c} double" for c in columns)
    return _r(spark.read.schema(schema).json(f"{root}/summary"), *columns)
