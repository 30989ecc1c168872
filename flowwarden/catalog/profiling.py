"""Queries over the profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import force_numeric
from ..operators.profile import (
    class_counts, class_weights, column_report, correlations, describe, distinct_counts,
    drop_constant_columns, high_correlations, low_cardinality_columns, mean_ratio, missing_profile, missing_totals,
    outlier_profile, pruned_features, pruning_summary, redundant_columns, sampling_projection, text_profile, top_rows,
    top_variance, type_counts,
)
from ..schema import BENIGN
from .preparation import _NUM, _num
from ..plans.audit import audit_correlations, load_audit, save_audit
from ..session import scratch_path
from .registry import query
from .views import WITH_FLOWS, WITH_RAW, flows, raw_flows

_COLS = ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "syn_pkts", "fin_pkts", "psh_pkts", "urg_pkts", "duration_ms", "ae_score")
_RAW_NUMBERS = f"{WITH_RAW}, nums AS (SELECT {', '.join(f'{_num(c)} AS {chr(34)}{c}{chr(34)}' for c in _NUM)} FROM raw_flows_v)"


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _numbers(spark, sf_dir):
    return force_numeric(raw_flows(spark, sf_dir), _NUM).select(*[F.col(f"`{c}`") for c in _NUM])


def _each(template: str, columns, source: str) -> str:
    """One SELECT per column, united."""
    return " UNION ALL ".join("SELECT " + template.format(c=f'"{c}"', name=c) + f" FROM {source}" for c in columns)


def _files(spark, sf_dir):
    return flows(spark, sf_dir).withColumn("source_file", F.concat(F.lit("day"), (F.col("l_suppkey") % 4).cast("string")))


_FILES = f"{WITH_FLOWS}, f AS (SELECT *, concat('day', CAST(l_suppkey % 4 AS VARCHAR)) AS source_file FROM flows_v)"


@query("a01_class_counts", f"""{_FILES}, c AS (SELECT source_file AS file, label, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT * FROM c UNION ALL SELECT NULL, label, sum(n) FROM c GROUP BY label)
SELECT file, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY file), 6) AS pct FROM u""")
def a01(spark, sf_dir):
    return _r(class_counts(_files(spark, sf_dir), "label"), "pct")


@query("a02_sampling_projection", f"""{_FILES}, c AS (SELECT source_file AS file, count(*) FILTER (label = 'Benign') AS benign,
  count(*) FILTER (label <> 'Benign') AS attack FROM f GROUP BY ALL), t AS (SELECT *, least(benign, 1000) AS taken FROM c),
u AS (SELECT * FROM t UNION ALL SELECT NULL, sum(benign), sum(attack), sum(taken) FROM t)
SELECT *, round(attack / (attack + taken), 6) AS attack_ratio FROM u""")
def a02(spark, sf_dir):
    return _r(sampling_projection(_files(spark, sf_dir), 1000, "label"), "attack_ratio")


@query("a03_type_counts", f"""{WITH_FLOWS}, t AS (SELECT unnest(['bigint','int','bigint','bigint','string','string','int','int','int','bigint','bigint',
  'bigint','bigint','double','double','double','double','double','double','double','string','double','string']) AS type, count(*) AS r FROM flows_v)
SELECT type, count(*) AS n_columns, max(r) AS n_rows FROM t GROUP BY type""")
def a03(spark, sf_dir):
    df = flows(spark, sf_dir)
    return type_counts(df).withColumn("n_rows", df.agg(F.count("*")).scalar())


@query("a03_text_profile", f"""{WITH_RAW}, v AS ({_each("'{name}' AS column_name, {c} AS value", ("source_file", "Dst Port", "Tot Fwd Pkts", "TotLen Fwd Pkts", "Flow Byts/s", "SYN Flag Cnt", "Fwd Byts/b Avg", "Timestamp"), "raw_flows_v")}),
d AS (SELECT DISTINCT column_name, value FROM v WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rn FROM d)
SELECT column_name, count(*) AS n_distinct, list(value ORDER BY value) FILTER (rn <= 5) AS samples FROM r GROUP BY column_name""")
def a03_text(spark, sf_dir):
    return text_profile(raw_flows(spark, sf_dir))


_MISSING = _each(
    "'{name}' AS column_name, count(*) FILTER ({c} IS NULL OR isnan({c})) AS n_missing, count(*) FILTER (isinf({c})) AS n_inf, count(*) AS n",
    _NUM, "nums")


@query("a04_missing_profile", f"""{_RAW_NUMBERS}, m AS ({_MISSING})
SELECT column_name, n_missing, n_inf, round(100.0 * n_missing / n, 6) AS missing_pct, round(100.0 * n_inf / n, 6) AS inf_pct FROM m""")
def a04(spark, sf_dir):
    return _r(missing_profile(_numbers(spark, sf_dir), _NUM), "missing_pct", "inf_pct")


@query("a04_missing_totals", f"{_RAW_NUMBERS}, m AS ({_MISSING}) SELECT sum(n_missing) AS missing_cells, sum(n_inf) AS inf_cells FROM m")
def a04_totals(spark, sf_dir):
    return missing_totals(missing_profile(_numbers(spark, sf_dir), _NUM))


@query("a05_describe", f"""{_RAW_NUMBERS}, m AS ({_each("'{name}' AS column_name, {c} AS v", _NUM, "nums")}), k AS (SELECT * FROM m WHERE isfinite(v))
SELECT column_name, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 FROM k GROUP BY ALL""")
def a05(spark, sf_dir):
    return _r(describe(_numbers(spark, sf_dir), _NUM), "mean", "std", "q25", "q50", "q75")


def _ratio_sql(a: str, b: str) -> str:
    return _each(
        "'{name}' AS column_name, round(avg({c}) FILTER (" + a + "), 6) AS first_mean, round(avg({c}) FILTER (" + b + "), 6) AS second_mean, "
        "round(abs(avg({c}) FILTER (" + a + ") / nullif(avg({c}) FILTER (" + b + "), 0)), 6) AS ratio", _COLS, "flows_v")


@query("a06_mean_ratio", f"{WITH_FLOWS} {_ratio_sql(chr(108) + 'abel <> ' + repr(BENIGN), 'label = ' + repr(BENIGN))}")
def a06(spark, sf_dir):
    df = mean_ratio(flows(spark, sf_dir), _COLS, F.col("label") != BENIGN, F.col("label") == BENIGN)
    return _r(df, "first_mean", "second_mean", "ratio")


@query("a06_class_pair_ratio", f"{WITH_FLOWS} {_ratio_sql('label = ' + repr('Bot'), 'label = ' + repr('SSH-Bruteforce'))}")
def a06_pair(spark, sf_dir):
    df = mean_ratio(flows(spark, sf_dir), _COLS, F.col("label") == "Bot", F.col("label") == "SSH-Bruteforce")
    return _r(df, "first_mean", "second_mean", "ratio")


@query("t01_top_ratio", f"""{WITH_FLOWS}, m AS ({_ratio_sql('label <> ' + repr(BENIGN), 'label = ' + repr(BENIGN))})
SELECT column_name, ratio FROM m ORDER BY ratio DESC NULLS LAST, column_name LIMIT 5""")
def t01(spark, sf_dir):
    df = mean_ratio(flows(spark, sf_dir), _COLS, F.col("label") != BENIGN, F.col("label") == BENIGN)
    return top_rows(_r(df, "ratio"), "ratio", 5).select("column_name", "ratio")


@query("t01_bottom_ratio", f"""{WITH_FLOWS}, m AS ({_ratio_sql('label <> ' + repr(BENIGN), 'label = ' + repr(BENIGN))})
SELECT column_name, ratio FROM m ORDER BY ratio ASC NULLS LAST, column_name LIMIT 3""")
def t01_bottom(spark, sf_dir):
    df = mean_ratio(flows(spark, sf_dir), _COLS, F.col("label") != BENIGN, F.col("label") == BENIGN)
    return top_rows(_r(df, "ratio"), "ratio", 3, descending=False).select("column_name", "ratio")


@query("a07_outlier_profile", f"""{WITH_FLOWS}, m AS ({_each("'{name}' AS column_name, CAST({c} AS DOUBLE) AS v", _COLS, "flows_v")}),
q AS (SELECT column_name, min(v) AS min, max(v) AS max, quantile_cont(v, 0.001) AS p001, quantile_cont(v, 0.999) AS p999 FROM m GROUP BY ALL)
SELECT column_name, min, max, round(p001, 6) AS p001, round(p999, 6) AS p999, round(abs(max / nullif(p999, 0)), 6) AS max_ratio FROM q""")
def a07(spark, sf_dir):
    return _r(outlier_profile(flows(spark, sf_dir), _COLS), "p001", "p999", "max_ratio")


# A column that repeats another one and a constant one, as in real flow data.
_CORR = (*_COLS, "fwd_act", "subflow_bytes", "one")
_CORR_VIEW = f"{WITH_FLOWS}, c AS (SELECT *, fwd_pkts AS fwd_act, fwd_bytes + bwd_pkts AS subflow_bytes, 1 AS one FROM flows_v)"


def _corr_frame(spark, sf_dir):
    return flows(spark, sf_dir).withColumns({
        "fwd_act": F.col("fwd_pkts"), "subflow_bytes": F.col("fwd_bytes") + F.col("bwd_pkts"), "one": F.lit(1),
    })


def _corr_sql() -> str:
    rows = []
    for i, a in enumerate(_CORR):
        for j, b in enumerate(_CORR):
            if i <= j:
                r = "CAST(max(NULL) AS DOUBLE)" if "one" in (a, b) else f"corr({a}, {b})"
                rows.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS feat_a, '{b}' AS feat_b, {r} AS r FROM c")
    return " UNION ALL ".join(rows)


@query("a09_correlation", f"{_CORR_VIEW}, r AS ({_corr_sql()}) SELECT i, j, feat_a, feat_b, round(r, 6) + 0.0 AS r FROM r")
def a09(spark, sf_dir):
    return _pos(correlations(_corr_frame(spark, sf_dir), _CORR), "r")


def _pos(df, c):
    return df.withColumn(c, F.round(c, 6) + F.lit(0.0))


@query("a09_correlation_wide", f"{_CORR_VIEW}, r AS ({_corr_sql()}) SELECT i, j, feat_a, feat_b, round(r, 6) + 0.0 AS r FROM r WHERE feat_a <> 'one' AND feat_b <> 'one'")
def a09_wide(spark, sf_dir):
    return _pos(correlations(_corr_frame(spark, sf_dir), [c for c in _CORR if c != "one"]), "r")


_HIGH = f"""{_CORR_VIEW}, r AS ({_corr_sql()}),
 both_ AS (SELECT feat_a AS f, r FROM r UNION ALL SELECT feat_b, r FROM r WHERE i <> j),
 m AS (SELECT f, round(avg(abs(r)), 12) AS mr FROM both_ GROUP BY f),
 high AS (SELECT i, j, feat_a, feat_b, round(r, 6) AS correlation, CASE WHEN mb.mr <= ma.mr THEN feat_b ELSE feat_a END AS drop_candidate
   FROM r JOIN m ma ON ma.f = feat_a JOIN m mb ON mb.f = feat_b WHERE i < j AND abs(r) >= {{t}})"""


@query("a10_high_correlation", f"{_HIGH.format(t=0.5)} SELECT * FROM high")
def a10(spark, sf_dir):
    return high_correlations(correlations(_corr_frame(spark, sf_dir), _CORR), 0.5)


_GREEDY = f"""{_HIGH.format(t=0.5)}, o AS (SELECT *, row_number() OVER (ORDER BY -abs(correlation), j, i) AS rn FROM high),
 st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS dropped UNION ALL
   SELECT k + 1, CASE WHEN list_contains(dropped, feat_a) OR list_contains(dropped, feat_b) THEN dropped ELSE list_append(dropped, drop_candidate) END
   FROM st JOIN o ON o.rn = k + 1),
 d AS (SELECT unnest(dropped) AS dropped FROM (SELECT dropped FROM st ORDER BY k DESC LIMIT 1))"""


def _feature_list(spark, sf_dir):
    return column_report(_corr_frame(spark, sf_dir), _CORR, {"n": F.count}, "feature")


@query("u03_redundant_columns", f"{_GREEDY} SELECT dropped FROM d")
def u03(spark, sf_dir):
    return redundant_columns(high_correlations(correlations(_corr_frame(spark, sf_dir), _CORR), 0.5))


@query("u02_pruned_features", f"""{_GREEDY}, f AS (SELECT unnest([{", ".join(f"'{c}'" for c in _CORR)}]) AS feature)
SELECT feature, (SELECT count(*) FROM flows_v) AS n FROM f WHERE feature NOT IN (SELECT dropped FROM d)""")
def u02(spark, sf_dir):
    dropped = redundant_columns(high_correlations(correlations(_corr_frame(spark, sf_dir), _CORR), 0.5))
    return pruned_features(_feature_list(spark, sf_dir), dropped)


@query("a20_pruning_summary", f"""{_GREEDY} SELECT 0.5 AS threshold, {len(_CORR)} AS n_original_features,
  {len(_CORR)} - (SELECT count(*) FROM d) AS n_pruned_features, (SELECT count(*) FROM d) AS n_dropped, (SELECT count(*) FROM high) AS n_pairs_found""")
def a20(spark, sf_dir):
    high = high_correlations(correlations(_corr_frame(spark, sf_dir), _CORR), 0.5)
    return pruning_summary(_feature_list(spark, sf_dir), high, redundant_columns(high), 0.5)


@query("e03_correlation_job", f"""{_GREEDY}, f AS (SELECT unnest([{", ".join(f"'{c}'" for c in _CORR)}]) AS feature, unnest(range({len(_CORR)})) AS position)
SELECT CAST(position AS INTEGER) AS position, feature, 0.5E0 AS threshold, {len(_CORR)} AS n_original_features, {len(_CORR)} - (SELECT count(*) FROM d) AS n_pruned_features,
  (SELECT count(*) FROM high) AS n_pairs_found, (SELECT count(*) FROM high WHERE drop_candidate = feature) AS named_to_drop
FROM f WHERE feature NOT IN (SELECT dropped FROM d)""")
def e03(spark, sf_dir):
    """The whole correlation job: audited, stored, read back; the pruned list with the report's counts."""
    root = scratch_path(spark, "audit")
    save_audit(audit_correlations(_corr_frame(spark, sf_dir), _CORR, 0.5), root)
    audit = load_audit(spark, root)
    named = audit.pairs.groupBy(F.col("drop_candidate").alias("feature")).agg(F.count("*").alias("named_to_drop"))
    counts = audit.summary.select(F.struct("threshold", "n_original_features", "n_pruned_features", "n_pairs_found").alias("s")).scalar()
    listed = audit.pruned.join(named, "feature", "left")
    return listed.select("position", "feature", F.coalesce("named_to_drop", F.lit(0)).alias("named_to_drop"), F.inline(F.array(counts)))


@query("a22_top_variance", f"""{WITH_FLOWS}, m AS ({_each("'{name}' AS column_name, round(var_samp({c}), 4) AS variance", _COLS, "flows_v")})
SELECT * FROM m ORDER BY variance DESC, column_name LIMIT 5""")
def a22(spark, sf_dir):
    return top_variance(flows(spark, sf_dir), _COLS, 5).withColumn("variance", F.round("variance", 4))


_DISTINCT = f"""{WITH_FLOWS}, z AS (SELECT *, 1 AS one FROM flows_v), v AS ({_each("'{name}' AS column_name, CAST({c} AS DOUBLE) AS value", (*_COLS, "one", "protocol"), "z")}),
 k AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL), d AS (SELECT column_name, count(*) AS n_distinct FROM k GROUP BY ALL)"""


def _with_constant(spark, sf_dir):
    return flows(spark, sf_dir).withColumn("one", F.lit(1))


@query("f06_near_constant", f"""{_DISTINCT} SELECT column_name, n_distinct, value, n FROM d JOIN k USING (column_name) WHERE n_distinct <= 5""")
def f06(spark, sf_dir):
    df = low_cardinality_columns(_with_constant(spark, sf_dir), (*_COLS, "one", "protocol"))
    return df.select("column_name", "n_distinct", F.inline("value_counts"))


@query("f06_distinct_counts", f"{_DISTINCT} SELECT * FROM d")
def f06_distinct(spark, sf_dir):
    counts = distinct_counts(_with_constant(spark, sf_dir), (*_COLS, "one", "protocol"))
    return counts.groupBy("column_name").agg(F.count("*").alias("n_distinct"))


@query("f06_drop_constant", f"{WITH_FLOWS} SELECT {', '.join(_COLS[:5])}, count(*) AS n FROM flows_v GROUP BY ALL")
def f06_drop(spark, sf_dir):
    columns = [*_COLS[:5], "one"]
    df = drop_constant_columns(_with_constant(spark, sf_dir).select(*columns), columns)
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


@query("a18_class_weights", f"""{WITH_FLOWS}, c AS (SELECT label, count(*) AS n FROM flows_v GROUP BY label)
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS raw_weight, round(least(sum(n) OVER () / (count(*) OVER () * n), 3), 6) AS weight FROM c""")
def a18(spark, sf_dir):
    return _r(class_weights(flows(spark, sf_dir), "label", 3.0), "raw_weight", "weight")


@query("j02_scalar_lookup", f"""{WITH_FLOWS}, c AS (SELECT label, count(*) AS n FROM flows_v GROUP BY label),
 w AS (SELECT label, least(sum(n) OVER () / (count(*) OVER () * n), 20) AS weight FROM c)
SELECT label, round(sum(weight), 4) AS total_weight FROM flows_v JOIN w USING (label) GROUP BY label""")
def j02(spark, sf_dir):
    from ..functions.joins import join_lookup
    from ..session import materialise

    df = flows(spark, sf_dir)
    weights = materialise(class_weights(df, "label").select("label", "weight"))
    return join_lookup(df, weights, ["label"]).groupBy("label").agg(F.round(F.sum("weight"), 4).alias("total_weight"))
