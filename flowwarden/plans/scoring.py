"""The scoring job: model outputs in, verdicts out. Works on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, DetectionConfig
from ..functions.verdicts import action
from ..operators.fusion import anomaly_flag, anomaly_threshold, fuse, is_attack, is_whitelisted
from ..operators.rules import Rule, apply_rules, flow_port, flow_protocol, with_rule_inputs


def score_flows(
    df: DataFrame, cfg: DetectionConfig = DEFAULT, rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Verdict columns for flows that carry ``rf_label``, ``rf_confidence`` and ``ae_score``.

    One narrow projection chain: no shuffle, no Python, as many rows out as in.
    Whitelisted flows skip models and rules through one guard column. Their
    model columns may be NULL.
    """
    port, protocol = F.col("flow_port"), F.col("flow_protocol")
    white = F.col("whitelisted")
    located = with_rule_inputs(df).withColumns({"flow_port": flow_port(df), "flow_protocol": flow_protocol(df)})
    prepared = located.withColumns({
        "whitelisted": is_whitelisted(port, F.col("src_ip"), F.col("dst_ip"), cfg),
        "threshold": anomaly_threshold(port, protocol, cfg),
    }).withColumns({
        "label": F.when(white, F.lit(cfg.benign_label)).otherwise(F.col("rf_label")),
        "confidence": F.when(white, F.lit(1.0)).otherwise(F.col("rf_confidence")),
        "anomaly_score": F.when(white, F.lit(0.0)).otherwise(F.col("ae_score")),
        "anomaly_flagged": ~white & anomaly_flag(F.col("ae_score"), F.col("threshold")),
    })
    verdict, source = fuse(
        F.col("label") != cfg.benign_label, F.col("confidence"), F.col("anomaly_flagged"), F.col("anomaly_score"), cfg
    )
    fused = prepared.withColumns({
        "verdict": F.when(white, F.lit("BENIGN")).otherwise(verdict),
        "source": F.when(white, F.lit("WHITELIST")).otherwise(source),
    })
    ruled = apply_rules(fused, cfg, rules, guard=~white)
    return ruled.withColumns({
        "is_attack": is_attack(F.col("verdict")),
        "action": action(F.col("verdict")),
    }).drop("flow_port", "flow_protocol", "threshold")


def rounded_verdict(df: DataFrame) -> DataFrame:
    """Confidence and probabilities to 4 decimals, score to 6."""
    out = {"confidence": F.round("confidence", 4), "anomaly_score": F.round("anomaly_score", 6)}
    if "class_probabilities" in df.columns:
        out["class_probabilities"] = F.transform_values("class_probabilities", lambda _, p: F.round(p, 4))
    return df.withColumns(out)


def verdict_counts(scored: DataFrame) -> DataFrame:
    """Totals of a scored batch."""
    v = F.col("verdict")
    return scored.agg(
        F.count("*").alias("total"),
        *[F.count_if(v == name).alias(f"{name.lower()}_count") for name in ("ATTACK", "SUSPECT", "ANOMALY", "BENIGN")],
    )


def verdict_summary(scored: DataFrame) -> DataFrame:
    """Flows per verdict, source and action."""
    return scored.groupBy("verdict", "source", "action").agg(
        F.count("*").alias("flows"), F.count_if("rule_fired").alias("rule_hits")
    )
