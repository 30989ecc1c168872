"""Detection thresholds, passed explicitly to the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DetectionConfig:
    """Defaults every verdict depends on. Override with ``dataclasses.replace``."""

    benign_label: str = "Benign"

    # score fusion
    ae_threshold: float = 0.45
    ae_threshold_by_port: dict[int, float] = field(
        default_factory=lambda: {53: 2.0, 67: 999.0, 68: 999.0, 80: 0.55, 443: 1.0, 1900: 999.0}
    )
    ae_threshold_by_protocol: dict[int, float] = field(default_factory=lambda: {1: 3.5, 2: 999.0})
    ae_hard_threshold: float = 5.0
    rf_confidence_high: float = 0.70

    # whitelist
    whitelist_ports: tuple[int, ...] = (67, 68, 5353, 1900, 631)
    whitelist_addresses: tuple[str, ...] = (
        "255.255.255.255", "224.0.0.1", "224.0.0.251", "239.255.255.250",
    )

    # rules
    rules_enabled: bool = True
    web_ports: tuple[int, ...] = (80, 443, 8080, 8443)
    syn_flood_ratio: float = 0.90
    portscan_syns: int = 5
    brute_force_ports: tuple[int, ...] = (21, 22, 23, 25, 3389, 5900)
    brute_min_syns: int = 8
    slowloris_min_duration_s: float = 10.0
    slowloris_max_bps: float = 200.0
    slowloris_max_packets: int = 30
    scanner_min_pps: float = 20.0
    scanner_urg_ratio: float = 0.05
    injection_psh_ratio: float = 0.60
    icmp_min_packets: int = 50
    empty_udp_max_bytes: int = 10
    udp_service_ports: tuple[int, ...] = (53, 67, 68, 5353)
    http_probe_max_bps: float = 50.0

    # alerts
    alert_verdicts: str = "ATTACK,SUSPECT,ANOMALY"
    dedup_window_s: float = 30.0

    # flow assembly
    idle_timeout_ms: int = 120_000
    active_timeout_ms: int = 1_800_000


DEFAULT = DetectionConfig()
