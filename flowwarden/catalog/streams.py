"""Queries over alert suppression, flow assembly and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.assembly import assemble_flows
from ..operators.dedup import dedup_counts, dedup_timeline, sent_alerts
from ..operators.features import flow_features
from ..plans.reports import stream_counters
from ..session import scratch_path
from ..sources.streams import read_flow_stream, write_alerts, write_stream
from ..streaming.assembly import assemble_stream
from ..streaming.counters import CounterLog, counter_totals as observed_totals, observed
from ..streaming.dedup import dedup_stream, sent_alert_stream
from ..streaming.jobs import counter_totals, live_alerts, score_stream, write_counters
from .registry import query
from .scoring import _ACTION_SQL, _LABEL_SQL, _SCORE6, _SOURCE_SQL, WITH_SCORED, scored_flows
from .views import FLOWS_V, KEYS, PACKETS_V, WITH_FLOWS, WITH_PACKETS, as_features, flows, packets, table

_DEDUP_KEY = ("src_ip", "dst_ip", "rf_label")


def _chain_sql(source: str, keys, time: str, window: int) -> str:
    """CTEs ev, st: alerts per key and time, and the greedy chain over them."""
    k = ", ".join(keys)
    on = " AND ".join(f"e.{x} = s.{x}" for x in keys)
    return f"""ev AS (SELECT {k}, {time} AS t, count(*) AS n FROM {source} GROUP BY ALL),
 st AS (SELECT {k}, min(t) AS t FROM ev GROUP BY ALL UNION ALL
   SELECT {', '.join('s.' + x for x in keys)}, (SELECT min(e.t) FROM ev e WHERE {on} AND e.t >= s.t + {window}) FROM st s
   WHERE EXISTS (SELECT 1 FROM ev e WHERE {on} AND e.t >= s.t + {window})),
 sp AS (SELECT *, lead(t) OVER (PARTITION BY {k} ORDER BY t) AS nt FROM st),
 held AS (SELECT {', '.join('s.' + x for x in keys)}, s.t, s.nt, sum(e.n) - 1 AS held FROM sp s JOIN ev e ON {on} AND e.t >= s.t AND (s.nt IS NULL OR e.t < s.nt) GROUP BY ALL),
 line AS (SELECT {k}, t AS sent_ms, lag(held, 1, 0) OVER (PARTITION BY {k} ORDER BY t) AS suppressed FROM held
   UNION ALL SELECT {k}, NULL, held FROM held WHERE nt IS NULL AND held > 0)"""


@query("d02_dedup", f"{WITH_FLOWS}, {_chain_sql('flows_v', _DEDUP_KEY, 'start_time_ms', 30000)} SELECT {', '.join(_DEDUP_KEY)}, sent_ms FROM line WHERE sent_ms IS NOT NULL")
def d02(spark, sf_dir):
    return dedup_timeline(flows(spark, sf_dir), _DEDUP_KEY, "start_time_ms").filter("sent_ms IS NOT NULL").drop("suppressed")


@query("d03_suppressed", f"{WITH_FLOWS}, {_chain_sql('flows_v', _DEDUP_KEY, 'start_time_ms', 30000)} SELECT {', '.join(_DEDUP_KEY)}, sent_ms, suppressed FROM line")
def d03(spark, sf_dir):
    return dedup_timeline(flows(spark, sf_dir), _DEDUP_KEY, "start_time_ms")


_VK = ("src_ip", "dst_ip", "verdict")
_ELIGIBLE = f"{WITH_SCORED}, el AS (SELECT *, start_time_ms + duration_ms AS end_time_ms FROM scored WHERE verdict <> 'BENIGN')"


@query("d02_sent_alerts", f"""{_ELIGIBLE}, {_chain_sql('el', _VK, 'end_time_ms', 30000)},
 pick AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_VK)}, end_time_ms ORDER BY {', '.join(KEYS)}) AS rn FROM el)
SELECT {', '.join('p.' + k for k in KEYS)}, p.verdict, l.suppressed FROM line l JOIN pick p
  ON p.src_ip = l.src_ip AND p.dst_ip = l.dst_ip AND p.verdict = l.verdict AND p.end_time_ms = l.sent_ms AND rn = 1""")
def d02_rows(spark, sf_dir):
    alerts = scored_flows(spark, sf_dir).filter("verdict <> 'BENIGN'").select(*KEYS, *_VK, "end_time_ms")
    return sent_alerts(alerts, KEYS).select(*KEYS, "verdict", "suppressed")


@query("a19_counters", f"""{_ELIGIBLE}, {_chain_sql('el', _VK, 'end_time_ms', 30000)}
SELECT (SELECT count(*) FROM scored) AS flows, (SELECT count(*) FROM scored WHERE verdict = 'ATTACK') AS attack,
  (SELECT count(*) FROM scored WHERE verdict = 'SUSPECT') AS suspect, (SELECT count(*) FROM scored WHERE verdict = 'ANOMALY') AS anomaly,
  (SELECT count(*) FROM scored WHERE verdict = 'BENIGN') AS benign, (SELECT count(*) FROM scored WHERE len(fired) > 0) AS rule_hits,
  (SELECT count(*) FROM scored WHERE source LIKE 'HEUR:%') AS rule_raised,
  (SELECT count(*) FROM scored WHERE flabel IS NULL OR fconf IS NULL OR fscore IS NULL OR isnan(fscore)) AS errors,
  (SELECT count(sent_ms) FROM line) AS alerts_sent, (SELECT sum(suppressed) FROM line) AS alerts_suppressed""")
def a19(spark, sf_dir):
    return stream_counters(scored_flows(spark, sf_dir))


# ---- flow assembly: events are hours apart, so a gap of six hours and a cap of eight are used
_IDLE, _CAP = 6 * 3_600_000, 8 * 3_600_000
_SESSIONS = f"""{WITH_PACKETS}, p AS (SELECT *, epoch_us(ts) // 1000 AS t FROM packets_v),
 g AS (SELECT *, lag(t) OVER (PARTITION BY src_key, dst_key ORDER BY t) AS pt FROM p),
 s AS (SELECT *, max(CASE WHEN pt IS NULL OR t - pt >= {_IDLE} THEN t END) OVER (PARTITION BY src_key, dst_key ORDER BY t RANGE UNBOUNDED PRECEDING) AS session FROM g),
 ch AS (SELECT src_key, dst_key, session, session AS start FROM s GROUP BY ALL UNION ALL
   SELECT c.src_key, c.dst_key, c.session, (SELECT min(x.t) FROM s x WHERE x.src_key = c.src_key AND x.dst_key = c.dst_key AND x.session = c.session AND x.t >= c.start + {{cap}})
   FROM ch c WHERE EXISTS (SELECT 1 FROM s x WHERE x.src_key = c.src_key AND x.dst_key = c.dst_key AND x.session = c.session AND x.t >= c.start + {{cap}})),
 f AS (SELECT s.*, (SELECT max(c.start) FROM ch c WHERE c.src_key = s.src_key AND c.dst_key = s.dst_key AND c.session = s.session AND c.start <= s.t) AS flow FROM s),
 k AS (SELECT *, t - lag(t) OVER (PARTITION BY src_key, dst_key, flow ORDER BY t) AS gap,
   t - lag(t) OVER (PARTITION BY src_key, dst_key, flow, direction ORDER BY t) AS dgap FROM f)"""


def _side(name: str, way: str) -> str:
    w = f"FILTER (direction = '{way}')"
    return (
        f"count(*) {w} AS {name}_packets, round(coalesce(sum(pkt_size) {w}, 0), 4) AS {name}_bytes, coalesce(max(t) {w} - min(t) {w}, 0) AS {name}_duration, "
        f"coalesce(min(pkt_size) {w}, 0) AS {name}_min_ps, coalesce(max(pkt_size) {w}, 0) AS {name}_max_ps, "
        f"round(coalesce(avg(pkt_size) {w}, 0), 4) AS {name}_mean_ps, round(coalesce(stddev_samp(pkt_size) {w}, 0), 4) AS {name}_stddev_ps, "
        f"count(*) FILTER (direction = '{way}' AND tcp_flag = 'PSH') AS {name}_psh_packets, count(*) FILTER (direction = '{way}' AND tcp_flag = 'URG') AS {name}_urg_packets, "
        f"coalesce(min(dgap) {w}, 0) AS {name}_min_iat, coalesce(max(dgap) {w}, 0) AS {name}_max_iat, "
        f"round(coalesce(avg(dgap) {w}, 0), 4) AS {name}_mean_iat, round(coalesce(stddev_samp(dgap) {w}, 0), 3) AS {name}_stddev_iat"
    )


_FLOWS_SQL = f"""SELECT src_key, dst_key, min(t) AS bidirectional_first_seen_ms, max(t) AS bidirectional_last_seen_ms, max(t) - min(t) AS bidirectional_duration_ms,
  count(*) AS bidirectional_packets, round(sum(pkt_size), 4) AS bidirectional_bytes, min(pkt_size) AS bidirectional_min_ps, max(pkt_size) AS bidirectional_max_ps,
  round(avg(pkt_size), 4) AS bidirectional_mean_ps, round(coalesce(stddev_samp(pkt_size), 0), 4) AS bidirectional_stddev_ps,
  {_side('src2dst', 'fwd')}, {_side('dst2src', 'bwd')},
  coalesce(min(gap), 0) AS bidirectional_min_iat, coalesce(max(gap), 0) AS bidirectional_max_iat, round(coalesce(avg(gap), 0), 4) AS bidirectional_mean_iat,
  round(coalesce(stddev_samp(gap), 0), 3) AS bidirectional_stddev_iat,
  {', '.join(f"count(*) FILTER (tcp_flag = '{f}') AS bidirectional_{f.lower()}_packets" for f in ('FIN', 'SYN', 'RST', 'PSH', 'ACK', 'URG', 'CWR', 'ECE'))}
FROM k GROUP BY src_key, dst_key, flow"""


def _rounded(df):
    four = [c for c in df.columns if c.endswith(("_bytes", "mean_ps", "stddev_ps", "mean_iat"))]
    three = [c for c in df.columns if c.endswith("stddev_iat")]
    return df.withColumns({**{c: F.round(c, 4) for c in four}, **{c: F.round(c, 3) for c in three}})


@query("d05_flow_assembly", f"{_SESSIONS.format(cap=_CAP)} {_FLOWS_SQL}")
def d05(spark, sf_dir):
    return _rounded(assemble_flows(packets(spark, sf_dir), idle_ms=_IDLE, active_ms=_CAP, slice_ms=3_600_000))


@query("d05_default_timeouts", f"{_SESSIONS.format(cap=1800000).replace(str(_IDLE), '120000')} {_FLOWS_SQL}")
def d05_default(spark, sf_dir):
    return _rounded(assemble_flows(packets(spark, sf_dir)))


def assembled_features(spark, sf_dir):
    """The 72 features of flows assembled from the packet view."""
    meter = assemble_flows(packets(spark, sf_dir), idle_ms=_IDLE, active_ms=_CAP, slice_ms=3_600_000)
    return flow_features(meter.withColumns({"dst_port": F.col("dst_key") * 40, "protocol": F.lit(6)}), ("src_key", "dst_key"))


@query("d05_flow_features", f"""{_SESSIONS.format(cap=_CAP)}, fl AS ({_FLOWS_SQL})
SELECT src_key, dst_key, CAST(bidirectional_duration_ms * 1000 AS DOUBLE) AS "Flow Duration", CAST(src2dst_packets AS DOUBLE) AS "Tot Fwd Pkts",
  round(CASE WHEN src2dst_packets > 0 THEN dst2src_packets / src2dst_packets ELSE 0 END, 6) AS "Down/Up Ratio",
  CAST(dst_key * 40 AS DOUBLE) AS "Dst Port", CAST(bidirectional_syn_packets AS DOUBLE) AS "SYN Flag Cnt" FROM fl""")
def d05_features(spark, sf_dir):
    return assembled_features(spark, sf_dir).select(
        "src_key", "dst_key", "Flow Duration", "Tot Fwd Pkts", F.round("`Down/Up Ratio`", 6).alias("Down/Up Ratio"),
        "Dst Port", "SYN Flag Cnt",
    )


@query("d02_dedup_counts", f"{WITH_FLOWS}, {_chain_sql('flows_v', _DEDUP_KEY, 'start_time_ms', 30000)} SELECT count(DISTINCT ({', '.join(_DEDUP_KEY)})) AS n_keys, count(sent_ms) AS sent, sum(suppressed) AS suppressed FROM line")
def d02_counts(spark, sf_dir):
    return dedup_counts(dedup_timeline(flows(spark, sf_dir), _DEDUP_KEY, "start_time_ms"))


# ---- streaming jobs over the same tables, run until all available input is processed
#: longer than any table: what is held is then reported with the next sent alert alone
_NEVER_S = 1e9

def _table_stream(spark, sf_dir, name):
    return read_flow_stream(spark, sf_dir, table(spark, sf_dir, name).schema, pattern=f"{name}.parquet")


def flow_stream(spark, sf_dir):
    return spark.sql(FLOWS_V.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table_stream(spark, sf_dir, "lineitem"))


def packet_stream(spark, sf_dir):
    raw = spark.sql(PACKETS_V.replace("FROM events", "FROM {events}"), events=_table_stream(spark, sf_dir, "events"))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, df, name):
    """Run a stream to its end and read what it wrote."""
    out = scratch_path(spark, name)
    write_stream(df, out, scratch_path(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("s09_flow_stream", f"{WITH_FLOWS} SELECT {', '.join(KEYS)}, src_ip, dst_port, rf_confidence FROM flows_v")
def s09(spark, sf_dir):
    return _run(spark, flow_stream(spark, sf_dir).select(*KEYS, "src_ip", "dst_port", "rf_confidence"), "flows")


@query("d01_stream_scoring", f"""{WITH_SCORED} SELECT {', '.join(KEYS)}, verdict, source, {_ACTION_SQL} AS action FROM scored""")
def d01(spark, sf_dir):
    scored = score_stream(as_features(flow_stream(spark, sf_dir)))
    return _run(spark, scored.select(*KEYS, "verdict", "source", "action"), "scored")


@query("s10_alert_sink", f"""{WITH_SCORED} SELECT {', '.join(KEYS)}, verdict, {_ACTION_SQL} AS action FROM scored WHERE verdict <> 'BENIGN'""")
def s10(spark, sf_dir):
    out = scratch_path(spark, "alerts")
    scored = score_stream(as_features(flow_stream(spark, sf_dir)))
    write_alerts(scored, out, scratch_path(spark, "alerts-state"), keep=KEYS).awaitTermination()
    return spark.read.parquet(out).select(*KEYS, "verdict", "action")


@query("d02_stream_dedup", f"{WITH_FLOWS}, {_chain_sql('flows_v', _DEDUP_KEY, 'start_time_ms', 30000)} SELECT {', '.join(_DEDUP_KEY)}, sent_ms, suppressed FROM line WHERE sent_ms IS NOT NULL")
def d02_stream(spark, sf_dir):
    sent = dedup_stream(flow_stream(spark, sf_dir), _DEDUP_KEY, "start_time_ms", flush_s=_NEVER_S, delay="0 seconds")
    return _run(spark, sent, "dedup").filter("sent_ms IS NOT NULL")


@query("d02_stream_sent_alerts", f"""{_ELIGIBLE}, {_chain_sql('el', _VK, 'end_time_ms', 30000)},
 pick AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_VK)}, end_time_ms ORDER BY {', '.join(KEYS)}) AS rn FROM el)
SELECT {', '.join('p.' + k for k in KEYS)}, p.verdict, p.end_time_ms, l.suppressed FROM line l JOIN pick p
  ON p.src_ip = l.src_ip AND p.dst_ip = l.dst_ip AND p.verdict = l.verdict AND p.end_time_ms = l.sent_ms AND rn = 1""")
def d02_stream_rows(spark, sf_dir):
    """Scored flows of a stream in, the whole alert rows that are sent out."""
    alerts = score_stream(as_features(flow_stream(spark, sf_dir))).filter("verdict <> 'BENIGN'").select(*KEYS, *_VK, "end_time_ms")
    return _run(spark, sent_alert_stream(alerts, KEYS, flush_s=_NEVER_S, delay="0 seconds"), "sent").select(*KEYS, "verdict", "end_time_ms", "suppressed")


@query("e02_live_job", f"""{_ELIGIBLE}, {_chain_sql('el', _VK, 'end_time_ms', 30000)},
 pick AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_VK)}, end_time_ms ORDER BY {', '.join(KEYS)}) AS rn FROM el)
SELECT {', '.join('p.' + k for k in KEYS)}, {_ACTION_SQL.replace('verdict', 'p.verdict')} AS action, p.verdict, {_LABEL_SQL} AS label, flabel AS rf_label,
  round(fconf, 4) AS confidence, {_SOURCE_SQL} AS source, len(fired) AS n_flags, p.src_ip, p.dst_ip, src_port, dst_port, protocol, start_time_ms,
  p.end_time_ms, {_SCORE6} AS anomaly_score, flagged AS anomaly_flagged, l.suppressed
FROM line l JOIN pick p ON p.src_ip = l.src_ip AND p.dst_ip = l.dst_ip AND p.verdict = l.verdict AND p.end_time_ms = l.sent_ms AND rn = 1""")
def e02(spark, sf_dir):
    """Flow stream to alert payloads in one plan: verdicts, rules, suppression, payload."""
    sent = live_alerts(as_features(flow_stream(spark, sf_dir)), KEYS, flush_s=_NEVER_S, delay="0 seconds")
    out = _run(spark, sent, "live")
    return out.withColumn("n_flags", F.size("heuristic_flags").cast("bigint")).drop("heuristic_flags")


@query("d04_stream_counters", f"""{WITH_SCORED} SELECT count(*) AS flows, count(*) FILTER (verdict = 'ATTACK') AS attack, count(*) FILTER (verdict = 'SUSPECT') AS suspect,
  count(*) FILTER (verdict = 'ANOMALY') AS anomaly, count(*) FILTER (verdict = 'BENIGN') AS benign, count(*) FILTER (len(fired) > 0) AS rule_hits,
  count(*) FILTER (source LIKE 'HEUR:%') AS rule_raised FROM scored""")
def d04(spark, sf_dir):
    """Counters written per batch of the stream, summed over all batches."""
    out = scratch_path(spark, "counted")
    write_counters(score_stream(as_features(flow_stream(spark, sf_dir))), out, scratch_path(spark, "counted-state")).awaitTermination()
    return counter_totals(spark.read.parquet(out))


@query("a19_stream_counters", f"""{WITH_SCORED} SELECT count(*) AS flows, count(*) FILTER (verdict = 'ATTACK') AS attack, count(*) FILTER (verdict = 'SUSPECT') AS suspect,
  count(*) FILTER (verdict = 'ANOMALY') AS anomaly, count(*) FILTER (verdict = 'BENIGN') AS benign, count(*) FILTER (len(fired) > 0) AS rule_hits,
  count(*) FILTER (source LIKE 'HEUR:%') AS rule_raised, count(*) FILTER (flabel IS NULL OR fconf IS NULL OR fscore IS NULL OR isnan(fscore)) AS errors,
  count(*) > 0 AS has_rate FROM scored""")
def a19_stream(spark, sf_dir):
    """Counters observed while the stream is scored and written, stored per batch by a listener, summed over all batches."""
    path = scratch_path(spark, "observed")
    with CounterLog(spark, path) as log:
        scored = observed(score_stream(as_features(flow_stream(spark, sf_dir))))
        log.wait(write_stream(scored.select(*KEYS, "verdict"), scratch_path(spark, "judged"), scratch_path(spark, "judged-state")))
    totals = observed_totals(spark.read.parquet(path))
    return totals.withColumn("has_rate", F.col("flows_per_second") > 0).drop("flows_per_second")


# Flows that are still open when the stream ends stay in its state: those of the table that end an idle gap before its last packet are compared.
@query("d05_stream_assembly", f"""{_SESSIONS.format(cap=_CAP)}, fl AS ({_FLOWS_SQL}),
 nx AS (SELECT *, lead(bidirectional_first_seen_ms) OVER (PARTITION BY src_key, dst_key ORDER BY bidirectional_first_seen_ms) AS next_ms FROM fl)
SELECT * EXCLUDE (next_ms) FROM nx
WHERE next_ms IS NOT NULL OR bidirectional_last_seen_ms + {_IDLE} <= (SELECT max(t) FROM p)""")
def d05_stream(spark, sf_dir):
    return _rounded(_run(spark, assemble_stream(packet_stream(spark, sf_dir), idle_ms=_IDLE, active_ms=_CAP, delay="0 seconds"), "assembled"))
