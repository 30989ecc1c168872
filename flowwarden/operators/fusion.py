"""Whitelist, anomaly threshold and fusion of the two model outputs into a verdict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DEFAULT, DetectionConfig
from ..functions.verdicts import lookup


def is_whitelisted(port: Column, src_ip: Column, dst_ip: Column, cfg: DetectionConfig = DEFAULT) -> Column:
    """IPv6 on either side, a whitelisted port, or a broadcast/multicast address."""
    src, dst = F.coalesce(src_ip, F.lit("")), F.coalesce(dst_ip, F.lit(""))
    return (
        src.contains(":") | dst.contains(":")
        | port.isin(*cfg.whitelist_ports) | dst.isin(*cfg.whitelist_addresses)
    )


def anomaly_threshold(port: Column, protocol: Column, cfg: DetectionConfig = DEFAULT) -> Column:
    """Per-port threshold first, per-protocol where the flow has no port, else the default."""
    by_protocol = F.when(port == 0, lookup(protocol, cfg.ae_threshold_by_protocol))
    return F.coalesce(lookup(port, cfg.ae_threshold_by_port), by_protocol, F.lit(cfg.ae_threshold))


def anomaly_flag(score: Column, threshold: Column) -> Column:
    return score > threshold


def fuse(
    rf_attack: Column, confidence: Column, flagged: Column, score: Column, cfg: DetectionConfig = DEFAULT
) -> tuple[Column, Column]:
    """Verdict and source; the first matching case wins."""
    sure = confidence >= cfg.rf_confidence_high
    cases = [
        (score >= cfg.ae_hard_threshold, "ATTACK", "AE_HARD"),
        (rf_attack & sure, "ATTACK", "RF"),
        (rf_attack & flagged, "ATTACK", "RF+AE"),
        (rf_attack, "SUSPECT", "RF"),
        (flagged, "ANOMALY", "AE"),
    ]
    verdict = source = F
    for condition, v, s in cases:
        verdict, source = verdict.when(condition, F.lit(v)), source.when(condition, F.lit(s))
    return verdict.otherwise(F.lit("BENIGN")), source.otherwise(F.lit("RF+AE"))


def is_attack(verdict: Column) -> Column:
    return verdict.isin("ATTACK", "SUSPECT")
