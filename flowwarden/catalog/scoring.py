"""Queries over the verdict operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.verdicts import action, rule_suffix
from ..operators.alerts import alert_json, alert_payload, deliverable, eligible_alerts
from ..operators.fusion import anomaly_flag, anomaly_threshold, fuse, is_whitelisted
from ..operators.rules import built_in_rules, explain_rules, rule_inputs_long, rule_numbers, with_rule_inputs
from ..plans.scoring import rounded_verdict, score_flows, verdict_counts, verdict_summary
from .registry import query
from .views import KEYS, WITH_FLOWS, feature_flows

_K = ", ".join(KEYS)

# Rule conditions of the oracle, one per built-in rule, over the CTE `base` below.
_RULE_SQL = {
    "brute_force": "dst_port IN (21,22,23,25,3389,5900) AND syn_pkts >= 8 AND mean_pkt < 150",
    "slowloris": "web AND secs >= 10 AND bps <= 200 AND pkts <= 30 AND fin_pkts = 0",
    "syn_flood": "pkts >= 2 AND syn_pkts / pkts >= 0.9 AND syn_pkts >= 2",
    "portscan": "fwd_pkts <= 4 AND syn_pkts >= 5 AND bytes < 200",
    "icmp_flood": "protocol = 1 AND pkts >= 50",
    "empty_udp_probe": "protocol = 17 AND dst_port NOT IN (53,67,68,5353) AND bytes <= 10 AND bwd_pkts = 0",
    "web_scanner": "web AND secs > 0 AND pps >= 20 AND urg_pkts / pkts >= 0.05",
    "injection_tool": "web AND pkts >= 6 AND psh_pkts / pkts >= 0.6",
    "http_probe": "web AND secs >= 0.5 AND secs < 10 AND bps <= 50 AND bytes < 500",
}
_LEVELS = {"brute_force": "ATTACK", "slowloris": "ATTACK"}

WITH_BASE = f"""{WITH_FLOWS}, base0 AS (
  SELECT *, CAST(fwd_pkts + bwd_pkts AS DOUBLE) AS pkts, fwd_bytes + bwd_bytes AS bytes,
    CAST(duration_ms AS DOUBLE) / 1000.0E0 AS secs, dst_port IN (80,443,8080,8443) AS web,
    contains(src_ip, ':') OR contains(dst_ip, ':') OR dst_port IN (67,68,5353,1900,631)
      OR dst_ip IN ('255.255.255.255','224.0.0.1','224.0.0.251','239.255.255.250') AS white,
    CASE dst_port WHEN 53 THEN 2.0E0 WHEN 67 THEN 999.0E0 WHEN 68 THEN 999.0E0 WHEN 80 THEN 0.55E0
      WHEN 443 THEN 1.0E0 WHEN 1900 THEN 999.0E0
      ELSE CASE WHEN dst_port = 0 AND protocol = 1 THEN 3.5E0 WHEN dst_port = 0 AND protocol = 2 THEN 999.0E0
      ELSE 0.45E0 END END AS threshold
  FROM flows_v), base AS (
  SELECT *, CASE WHEN pkts > 0 THEN bytes / pkts ELSE 0 END AS mean_pkt,
    CASE WHEN secs > 0 THEN bytes / secs ELSE 0 END AS bps,
    CASE WHEN secs > 0 THEN pkts / secs ELSE 0 END AS pps FROM base0)"""

WITH_SCORED = f"""{WITH_BASE}, fused AS (
  SELECT *, CASE WHEN white THEN 'Benign' ELSE rf_label END AS flabel,
    CASE WHEN white THEN 1.0E0 ELSE rf_confidence END AS fconf,
    CASE WHEN white THEN 0.0E0 ELSE ae_score END AS fscore,
    NOT white AND ae_score > threshold AS flagged FROM base), judged AS (
  SELECT *, CASE WHEN white THEN 'BENIGN' WHEN fscore >= 5 THEN 'ATTACK'
      WHEN flabel <> 'Benign' AND (fconf >= 0.7 OR flagged) THEN 'ATTACK'
      WHEN flabel <> 'Benign' THEN 'SUSPECT' WHEN flagged THEN 'ANOMALY' ELSE 'BENIGN' END AS v0,
    CASE WHEN white THEN 'WHITELIST' WHEN fscore >= 5 THEN 'AE_HARD'
      WHEN flabel <> 'Benign' AND fconf >= 0.7 THEN 'RF' WHEN flabel <> 'Benign' AND flagged THEN 'RF+AE'
      WHEN flabel <> 'Benign' THEN 'RF' WHEN flagged THEN 'AE' ELSE 'RF+AE' END AS s0,
    list_filter([{", ".join(f"CASE WHEN NOT white AND {c} THEN '{n}' END" for n, c in _RULE_SQL.items())}],
      lambda x: x IS NOT NULL) AS fired FROM fused), folded AS (
  SELECT *, CASE v0 WHEN 'BENIGN' THEN 0 WHEN 'ANOMALY' THEN 1 WHEN 'SUSPECT' THEN 2 ELSE 3 END AS sev,
    list_filter(fired, lambda x: x IN ('brute_force','slowloris')) AS attack_rules FROM judged), scored AS (
  SELECT *, CASE WHEN len(attack_rules) > 0 THEN 'ATTACK' WHEN len(fired) > 0 AND sev < 2 THEN 'SUSPECT' ELSE v0 END AS verdict,
    CASE WHEN sev < 3 AND len(attack_rules) > 0 THEN 'HEUR:_rule_' || attack_rules[1]
      WHEN sev < 2 AND len(fired) > 0 THEN 'HEUR:_rule_' || fired[1] ELSE s0 END AS source FROM folded)"""

# Spark rounds the shortest decimal text of a double; the oracle does the same.
_SCORE6 = "CAST(round(CAST(CAST(fscore AS VARCHAR) AS DECIMAL(38,20)), 6) AS DOUBLE)"
_ACTION_SQL = "CASE verdict WHEN 'ATTACK' THEN 'block' WHEN 'SUSPECT' THEN 'alert' WHEN 'ANOMALY' THEN 'rate_limit+alert' ELSE 'pass' END"
_RULES_SQL = "coalesce(list_aggregate(list_transform(fired, lambda x: '_rule_' || x || ':' || x), 'string_agg', ','), '')"


def scored_flows(spark, sf_dir):
    return score_flows(feature_flows(spark, sf_dir))


@query("v05_score_flows", f"""{WITH_SCORED}
SELECT {_K}, flabel AS label, round(fconf, 4) AS confidence, {_SCORE6} AS anomaly_score,
  flagged AS anomaly_flagged, verdict, source, verdict IN ('ATTACK','SUSPECT') AS is_attack,
  {_ACTION_SQL} AS action, {_RULES_SQL} AS rules FROM scored""")
def v05(spark, sf_dir):
    return rounded_verdict(scored_flows(spark, sf_dir)).select(
        *KEYS, "label", "confidence", "anomaly_score", "anomaly_flagged", "verdict", "source", "is_attack", "action",
        rule_suffix(F.col("heuristic_flags")).alias("rules"),
    )


@query("v05_verdict_summary", f"""{WITH_SCORED}
SELECT verdict, source, {_ACTION_SQL} AS action, count(*) AS flows, count(*) FILTER (len(fired) > 0) AS rule_hits
FROM scored GROUP BY ALL""")
def verdicts(spark, sf_dir):
    return verdict_summary(scored_flows(spark, sf_dir))


@query("s11_batch_counts", f"""{WITH_SCORED}
SELECT count(*) AS total, count(*) FILTER (verdict = 'ATTACK') AS attack_count,
  count(*) FILTER (verdict = 'SUSPECT') AS suspect_count, count(*) FILTER (verdict = 'ANOMALY') AS anomaly_count,
  count(*) FILTER (verdict = 'BENIGN') AS benign_count FROM scored""")
def s11(spark, sf_dir):
    return verdict_counts(scored_flows(spark, sf_dir))


@query("v01_ae_threshold", f"{WITH_BASE} SELECT dst_port, protocol, threshold, count(*) AS flows FROM base GROUP BY ALL")
def v01(spark, sf_dir):
    df = feature_flows(spark, sf_dir)
    return df.groupBy(
        "dst_port", "protocol", anomaly_threshold(F.col("dst_port"), F.col("protocol")).alias("threshold")
    ).agg(F.count("*").alias("flows"))


@query("v02_anomaly_flag", f"{WITH_BASE} SELECT {_K}, ae_score > threshold AS flagged FROM base")
def v02(spark, sf_dir):
    df = feature_flows(spark, sf_dir)
    limit = anomaly_threshold(F.col("dst_port"), F.col("protocol"))
    return df.select(*KEYS, anomaly_flag(F.col("ae_score"), limit).alias("flagged"))


@query("v03_fusion", f"""{WITH_BASE}, f AS (SELECT *, ae_score > threshold AS flagged, rf_label <> 'Benign' AS rf FROM base)
SELECT {_K},
  CASE WHEN ae_score >= 5 OR (rf AND (rf_confidence >= 0.7 OR flagged)) THEN 'ATTACK' WHEN rf THEN 'SUSPECT'
    WHEN flagged THEN 'ANOMALY' ELSE 'BENIGN' END AS verdict,
  CASE WHEN ae_score >= 5 THEN 'AE_HARD' WHEN rf AND rf_confidence >= 0.7 THEN 'RF' WHEN rf AND flagged THEN 'RF+AE'
    WHEN rf THEN 'RF' WHEN flagged THEN 'AE' ELSE 'RF+AE' END AS source FROM f""")
def v03(spark, sf_dir):
    df = feature_flows(spark, sf_dir)
    flagged = anomaly_flag(F.col("ae_score"), anomaly_threshold(F.col("dst_port"), F.col("protocol")))
    verdict, source = fuse(F.col("rf_label") != "Benign", F.col("rf_confidence"), flagged, F.col("ae_score"))
    return df.select(*KEYS, verdict.alias("verdict"), source.alias("source"))


@query("v04_is_attack", f"""{WITH_SCORED}
SELECT verdict, verdict IN ('ATTACK','SUSPECT') AS is_attack, count(*) AS flows FROM scored GROUP BY ALL""")
def v04(spark, sf_dir):
    return scored_flows(spark, sf_dir).groupBy("verdict", "is_attack").agg(F.count("*").alias("flows"))


@query("f03_whitelist", f"{WITH_BASE} SELECT {_K}, src_ip, dst_ip, dst_port, white AS whitelisted FROM base")
def f03(spark, sf_dir):
    df = feature_flows(spark, sf_dir)
    white = is_whitelisted(F.col("dst_port"), F.col("src_ip"), F.col("dst_ip"))
    return df.select(*KEYS, "src_ip", "dst_ip", "dst_port", white.alias("whitelisted"))


# Numbers each rule reports, as oracle SQL.
_NUMBER_SQL = {
    "brute_force": {"port": "dst_port", "syns": "syn_pkts", "mean_pkt": "mean_pkt"},
    "slowloris": {"dur": "secs", "bps": "bps", "pkts": "pkts", "fin": "fin_pkts"},
    "syn_flood": {"ratio": "syn_pkts / pkts", "syns": "syn_pkts"},
    "portscan": {"fwd_pkts": "fwd_pkts", "syns": "syn_pkts", "bytes": "bytes"},
    "icmp_flood": {"pkts": "pkts"},
    "empty_udp_probe": {"bytes": "bytes"},
    "web_scanner": {"pps": "pps", "urg_ratio": "urg_pkts / pkts"},
    "injection_tool": {"psh_ratio": "psh_pkts / pkts", "pkts": "pkts"},
    "http_probe": {"bps": "bps", "bytes": "bytes", "dur": "secs"},
}
_RULE_IDS = {
    "brute_force": "h01", "slowloris": "h02", "syn_flood": "h03", "portscan": "h04", "icmp_flood": "h05",
    "empty_udp_probe": "h06", "web_scanner": "h07", "injection_tool": "h08", "http_probe": "h09",
}


def _register_rule(position: int, name: str) -> None:
    """One query per rule: the flows it fires on with the numbers it reports."""
    numbers = ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {k}" for k, sql in _NUMBER_SQL[name].items())

    @query(f"{_RULE_IDS[name]}_{name}", f"{WITH_BASE} SELECT {_K}, {numbers} FROM base WHERE {_RULE_SQL[name]}")
    def rule_query(spark, sf_dir):
        rule = built_in_rules()[position]
        hits = rule_numbers(feature_flows(spark, sf_dir), KEYS, rule)
        return hits.select(*KEYS, *[F.round(k, 6).alias(k) for k in rule.numbers])


for _i, _name in enumerate(_RULE_SQL):
    _register_rule(_i, _name)


@query("h10_rule_fold", f"""{WITH_SCORED}
SELECT v0 AS incoming, verdict, source, len(fired) AS n_rules, count(*) AS flows FROM scored WHERE NOT white GROUP BY ALL""")
def h10(spark, sf_dir):
    scored = scored_flows(spark, sf_dir).filter(~F.col("whitelisted"))
    verdict, _ = fuse(
        F.col("label") != "Benign", F.col("confidence"), F.col("anomaly_flagged"), F.col("anomaly_score")
    )
    return scored.groupBy(
        verdict.alias("incoming"), "verdict", "source", F.size("heuristic_flags").cast("bigint").alias("n_rules")
    ).agg(F.count("*").alias("flows"))


@query("h11_flag_names", f"""{WITH_SCORED}
SELECT {_K}, unnest(fired) AS rule FROM scored""")
def h11(spark, sf_dir):
    flags = scored_flows(spark, sf_dir).select(*KEYS, F.explode("heuristic_flags").alias("flag"))
    return flags.select(*KEYS, F.regexp_extract("flag", r":(\w+)\(", 1).alias("rule"))


# Flag texts of the oracle, one per built-in rule: printf template and its values over `base`.
_TEXT_SQL = {
    "brute_force": ("port=%d, syns=%d, mean_pkt=%.0fB", "dst_port, CAST(syn_pkts AS BIGINT), mean_pkt"),
    "slowloris": ("dur=%.1fs, bps=%.1f, pkts=%d, fin=%d", "secs, bps, CAST(pkts AS BIGINT), CAST(fin_pkts AS BIGINT)"),
    "syn_flood": ("ratio=%.2f, syns=%d", "syn_pkts / pkts, CAST(syn_pkts AS BIGINT)"),
    "portscan": ("fwd_pkts=%d, syns=%d, bytes=%d", "CAST(fwd_pkts AS BIGINT), CAST(syn_pkts AS BIGINT), CAST(bytes AS BIGINT)"),
    "icmp_flood": ("pkts=%d", "CAST(pkts AS BIGINT)"),
    "empty_udp_probe": ("bytes=%d, bwd_pkts=0", "CAST(bytes AS BIGINT)"),
    "web_scanner": ("pps=%.1f, urg_ratio=%.3f", "pps, urg_pkts / pkts"),
    "injection_tool": ("psh_ratio=%.2f, pkts=%d", "psh_pkts / pkts, CAST(pkts AS BIGINT)"),
    "http_probe": ("bps=%.1f, bytes=%d, dur=%.2fs", "bps, CAST(bytes AS BIGINT), secs"),
}


@query("h11_flag_texts", f"""{WITH_BASE}
{" UNION ALL ".join(
    f"SELECT {_K}, '_rule_{n}:{n}(' || printf('{t}', {v}) || ')' AS flag FROM base WHERE NOT white AND {_RULE_SQL[n]}"
    for n, (t, v) in _TEXT_SQL.items())}""")
def h11_texts(spark, sf_dir):
    return scored_flows(spark, sf_dir).select(*KEYS, F.explode("heuristic_flags").alias("flag"))


@query("h12_explain", f"""{WITH_BASE}
{" UNION ALL ".join(
    f"SELECT {_K}, '_rule_{n}' AS rule, {c} AS fired, CASE WHEN {c} THEN '{_LEVELS.get(n, 'SUSPECT')}' END AS verdict FROM base"
    for n, c in _RULE_SQL.items())}""")
def h12(spark, sf_dir):
    return explain_rules(feature_flows(spark, sf_dir), KEYS).drop("detail")


@query("h13_rule_inputs", f"""{WITH_FLOWS}
{" UNION ALL ".join(f"SELECT {_K}, '{k}' AS key, CAST({c} AS DOUBLE) AS value FROM flows_v" for k, c in [
    ("Tot Fwd Pkts", "fwd_pkts"), ("Tot Bwd Pkts", "bwd_pkts"), ("TotLen Fwd Pkts", "fwd_bytes"),
    ("TotLen Bwd Pkts", "bwd_bytes"), ("SYN Flag Cnt", "syn_pkts"), ("FIN Flag Cnt", "fin_pkts"),
    ("PSH Flag Cnt", "psh_pkts"), ("URG Flag Cnt", "urg_pkts"), ("Flow Duration", "duration_ms * 1000"),
    ("Dst Port", "dst_port"), ("Protocol", "protocol")])}""")
def h13(spark, sf_dir):
    return rule_inputs_long(feature_flows(spark, sf_dir), KEYS)


@query("p08_alias_inputs", f"""{WITH_FLOWS}
SELECT {_K}, CAST(syn_pkts AS DOUBLE) AS syn, CAST(CASE WHEN l_partkey % 7 = 0 THEN psh_pkts ELSE urg_pkts END AS DOUBLE) AS psh,
  CAST(duration_ms AS DOUBLE) / 1000.0E0 AS duration_s FROM flows_v""")
def p08(spark, sf_dir):
    raw = feature_flows(spark, sf_dir).withColumns({
        "bidirectional_syn_packets": F.col("SYN Flag Cnt"),
        "SYN Flag Cnt": F.lit(float("nan")),
        "bidirectional_psh_packets": F.when(F.col("l_partkey") % 7 == 0, F.col("PSH Flag Cnt")).otherwise(float("inf")),
        "Fwd PSH Flags": F.col("URG Flag Cnt"),
        "bidirectional_duration_ms": F.col("duration_ms"),
    }).drop("PSH Flag Cnt", "Flow Duration")
    return with_rule_inputs(raw).select(
        *KEYS, F.col("in_syn").alias("syn"), F.col("in_psh").alias("psh"), F.col("in_duration_s").alias("duration_s")
    )


@query("p13_rounded_verdict", f"""{WITH_SCORED}
SELECT {_K}, round(fconf, 4) AS confidence, {_SCORE6} AS anomaly_score FROM scored""")
def p13(spark, sf_dir):
    return rounded_verdict(scored_flows(spark, sf_dir)).select(*KEYS, "confidence", "anomaly_score")


@query("p13_rounded_probabilities", f"""{WITH_SCORED}, p AS (SELECT {_K}, unnest(['Benign', 'Bot', 'SSH-Bruteforce']) AS class,
  unnest([rf_confidence / 3, (1 - rf_confidence) / 7, 1 - rf_confidence / 3 - (1 - rf_confidence) / 7]) AS x FROM scored)
SELECT {_K}, class, CAST(round(CAST(CAST(x AS VARCHAR) AS DECIMAL(38,20)), 4) AS DOUBLE) AS probability FROM p""")
def p13_map(spark, sf_dir):
    """Every probability of the class map to 4 decimals."""
    c = F.col("rf_confidence")
    shares = {"Benign": c / 3, "Bot": (1 - c) / 7, "SSH-Bruteforce": 1 - c / 3 - (1 - c) / 7}
    given = feature_flows(spark, sf_dir).withColumn("class_probabilities", F.create_map(*[v for n, x in shares.items() for v in (F.lit(n), x)]))
    return rounded_verdict(score_flows(given)).select(*KEYS, F.explode("class_probabilities").alias("class", "probability"))


@query("p14_action", f"{WITH_SCORED} SELECT verdict, {_ACTION_SQL} AS action, count(*) AS flows FROM scored GROUP BY ALL")
def p14(spark, sf_dir):
    return scored_flows(spark, sf_dir).groupBy("verdict", action(F.col("verdict")).alias("action")).agg(
        F.count("*").alias("flows")
    )


_LABEL_SQL = """CASE fired[1] WHEN 'brute_force' THEN 'Brute Force' WHEN 'slowloris' THEN 'DoS attacks-Slowloris'
  WHEN 'syn_flood' THEN 'SYN Flood' WHEN 'portscan' THEN 'Port Scan' WHEN 'icmp_flood' THEN 'ICMP Flood'
  WHEN 'empty_udp_probe' THEN 'UDP Probe' WHEN 'web_scanner' THEN 'Web Scanner'
  WHEN 'injection_tool' THEN 'Injection Attack' WHEN 'http_probe' THEN 'HTTP Probe' ELSE flabel END"""
_SOURCE_SQL = "substr(replace(source, '_rule_', ''), 1, 16)"


@query("p15_alert_label", f"{WITH_SCORED} SELECT {_LABEL_SQL} AS label, count(*) AS flows FROM scored GROUP BY ALL")
def p15(spark, sf_dir):
    return alert_payload(scored_flows(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("flows"))


@query("p16_alert_source", f"{WITH_SCORED} SELECT {_SOURCE_SQL} AS source, count(*) AS flows FROM scored GROUP BY ALL")
def p16(spark, sf_dir):
    return alert_payload(scored_flows(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("flows"))


@query("p17_alert_payload", f"""{WITH_SCORED}
SELECT {_K}, {_ACTION_SQL} AS action, verdict, {_LABEL_SQL} AS label, flabel AS rf_label, round(fconf, 4) AS confidence,
  {_SOURCE_SQL} AS source, len(fired) AS n_flags, src_ip, dst_ip, src_port, dst_port, protocol, start_time_ms,
  start_time_ms + duration_ms AS end_time_ms, {_SCORE6} AS anomaly_score, flagged AS anomaly_flagged
FROM scored WHERE verdict <> 'BENIGN'""")
def p17(spark, sf_dir):
    payload = alert_payload(deliverable(scored_flows(spark, sf_dir)), KEYS)
    return payload.withColumn("n_flags", F.size("heuristic_flags").cast("bigint")).drop("heuristic_flags")


@query("p17_alert_json", f"""{WITH_SCORED}
SELECT {_K}, verdict, {_SOURCE_SQL} AS source, 16 AS n_fields FROM scored WHERE verdict <> 'BENIGN'""")
def p17_json(spark, sf_dir):
    text = alert_json(alert_payload(deliverable(scored_flows(spark, sf_dir)), KEYS), KEYS)
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return text.select(
        *KEYS, field("verdict"), field("source"),
        F.size(F.json_object_keys("value")).alias("n_fields"),
    )


@query("p18_rule_suffix", f"{WITH_SCORED} SELECT {_RULES_SQL} AS rules, count(*) AS flows FROM scored GROUP BY ALL")
def p18(spark, sf_dir):
    return scored_flows(spark, sf_dir).groupBy(rule_suffix(F.col("heuristic_flags")).alias("rules")).agg(
        F.count("*").alias("flows")
    )


@query("f04_alert_filter", f"""{WITH_SCORED}
SELECT {_K}, verdict FROM scored WHERE verdict IN ('ATTACK','SUSPECT','ANOMALY')""")
def f04(spark, sf_dir):
    return eligible_alerts(scored_flows(spark, sf_dir), DEFAULT).select(*KEYS, "verdict")
