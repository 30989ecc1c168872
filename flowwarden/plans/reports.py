"""Counters over scored flows and their alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, DetectionConfig
from ..operators.alerts import eligible_alerts
from ..operators.dedup import dedup_counts, dedup_timeline


def flow_counters() -> list:
    """Aggregates of one scored batch; also used as streaming metrics."""
    v = F.col("verdict")
    return [
        F.count(F.lit(1)).alias("flows"),
        *[F.count_if(v == name.upper()).alias(name) for name in ("attack", "suspect", "anomaly", "benign")],
        F.count_if("rule_fired").alias("rule_hits"),
        F.count_if(F.col("source").startswith("HEUR:")).alias("rule_raised"),
    ]


def error_count():
    """Flows that should have been judged but have no label or no finite score from their models."""
    unjudged = F.col("label").isNull() | F.col("confidence").isNull() | F.col("anomaly_score").isNull() | F.isnan("anomaly_score")
    return F.count_if(unjudged).alias("errors")


def stream_counters(scored: DataFrame, cfg: DetectionConfig = DEFAULT) -> DataFrame:
    """Flows per verdict, rule hits, rules that raised a verdict, flows without model outputs, alerts sent and suppressed."""
    alerts = eligible_alerts(scored, cfg).select("src_ip", "dst_ip", "verdict", "end_time_ms")
    sent = dedup_counts(dedup_timeline(alerts, window_s=cfg.dedup_window_s)).agg(
        F.struct(F.max("sent").alias("sent"), F.max("suppressed").alias("suppressed"))
    ).scalar()
    return scored.agg(*flow_counters(), error_count()).select(
        "*", sent["sent"].alias("alerts_sent"), sent["suppressed"].alias("alerts_suppressed")
    )
