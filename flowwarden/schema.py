"""Column names, class names and lookup tables of the flow data model.

Everything in this module is a fixed value: results only agree with other
consumers of the same flow format if these names and numbers are identical.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The ordered 72-column feature schema.
FEATURES: tuple[str, ...] = (
    "Dst Port",
    "Protocol",
    "Flow Duration",
    "Tot Fwd Pkts",
    "Tot Bwd Pkts",
    "TotLen Fwd Pkts",
    "TotLen Bwd Pkts",
    "Fwd Pkt Len Max",
    "Fwd Pkt Len Min",
    "Fwd Pkt Len Mean",
    "Fwd Pkt Len Std",
    "Bwd Pkt Len Max",
    "Bwd Pkt Len Min",
    "Bwd Pkt Len Mean",
    "Bwd Pkt Len Std",
    "Flow Byts/s",
    "Flow Pkts/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Flow IAT Max",
    "Flow IAT Min",
    "Fwd IAT Tot",
    "Fwd IAT Mean",
    "Fwd IAT Std",
    "Fwd IAT Max",
    "Fwd IAT Min",
    "Bwd IAT Tot",
    "Bwd IAT Mean",
    "Bwd IAT Std",
    "Bwd IAT Max",
    "Bwd IAT Min",
    "Fwd PSH Flags",
    "Bwd PSH Flags",
    "Fwd URG Flags",
    "Bwd URG Flags",
    "Fwd Header Len",
    "Bwd Header Len",
    "Fwd Pkts/s",
    "Bwd Pkts/s",
    "Pkt Len Min",
    "Pkt Len Max",
    "Pkt Len Mean",
    "Pkt Len Std",
    "Pkt Len Var",
    "FIN Flag Cnt",
    "SYN Flag Cnt",
    "RST Flag Cnt",
    "PSH Flag Cnt",
    "ACK Flag Cnt",
    "URG Flag Cnt",
    "CWE Flag Count",
    "ECE Flag Cnt",
    "Down/Up Ratio",
    "Pkt Size Avg",
    "Fwd Seg Size Avg",
    "Bwd Seg Size Avg",
    "Subflow Fwd Pkts",
    "Subflow Fwd Byts",
    "Subflow Bwd Pkts",
    "Subflow Bwd Byts",
    "Init Fwd Win Byts",
    "Init Bwd Win Byts",
    "Fwd Act Data Pkts",
    "Fwd Seg Size Min",
    "Active Mean",
    "Active Std",
    "Active Max",
    "Active Min",
    "Idle Mean",
    "Idle Std",
    "Idle Max",
    "Idle Min",
)

# Feature column -> flow-meter column it is read from (61 renames;
# the other 11 features are computed in operators/features.py).
METER_COLUMNS: dict[str, str] = {
    "Tot Fwd Pkts": "src2dst_packets",
    "Tot Bwd Pkts": "dst2src_packets",
    "TotLen Fwd Pkts": "src2dst_bytes",
    "TotLen Bwd Pkts": "dst2src_bytes",
    "Fwd Pkt Len Max": "src2dst_max_ps",
    "Fwd Pkt Len Min": "src2dst_min_ps",
    "Fwd Pkt Len Mean": "src2dst_mean_ps",
    "Fwd Pkt Len Std": "src2dst_stddev_ps",
    "Bwd Pkt Len Max": "dst2src_max_ps",
    "Bwd Pkt Len Min": "dst2src_min_ps",
    "Bwd Pkt Len Mean": "dst2src_mean_ps",
    "Bwd Pkt Len Std": "dst2src_stddev_ps",
    "Flow IAT Mean": "bidirectional_mean_iat",
    "Flow IAT Std": "bidirectional_stddev_iat",
    "Flow IAT Max": "bidirectional_max_iat",
    "Flow IAT Min": "bidirectional_min_iat",
    "Fwd IAT Tot": "src2dst_duration",
    "Fwd IAT Mean": "src2dst_mean_iat",
    "Fwd IAT Std": "src2dst_stddev_iat",
    "Fwd IAT Max": "src2dst_max_iat",
    "Fwd IAT Min": "src2dst_min_iat",
    "Bwd IAT Tot": "dst2src_duration",
    "Bwd IAT Mean": "dst2src_mean_iat",
    "Bwd IAT Std": "dst2src_stddev_iat",
    "Bwd IAT Max": "dst2src_max_iat",
    "Bwd IAT Min": "dst2src_min_iat",
    "Fwd PSH Flags": "src2dst_psh_packets",
    "Fwd URG Flags": "src2dst_urg_packets",
    "Bwd PSH Flags": "dst2src_psh_packets",
    "Bwd URG Flags": "dst2src_urg_packets",
    "Fwd Header Len": "src2dst_header_bytes",
    "Bwd Header Len": "dst2src_header_bytes",
    "Pkt Len Min": "bidirectional_min_ps",
    "Pkt Len Max": "bidirectional_max_ps",
    "Pkt Len Mean": "bidirectional_mean_ps",
    "Pkt Len Std": "bidirectional_stddev_ps",
    "FIN Flag Cnt": "bidirectional_fin_packets",
    "SYN Flag Cnt": "bidirectional_syn_packets",
    "RST Flag Cnt": "bidirectional_rst_packets",
    "PSH Flag Cnt": "bidirectional_psh_packets",
    "ACK Flag Cnt": "bidirectional_ack_packets",
    "URG Flag Cnt": "bidirectional_urg_packets",
    "CWE Flag Count": "bidirectional_cwr_packets",
    "ECE Flag Cnt": "bidirectional_ece_packets",
    "Pkt Size Avg": "bidirectional_mean_ps",
    "Fwd Seg Size Avg": "src2dst_mean_ps",
    "Bwd Seg Size Avg": "dst2src_mean_ps",
    "Subflow Fwd Pkts": "src2dst_packets",
    "Subflow Fwd Byts": "src2dst_bytes",
    "Subflow Bwd Pkts": "dst2src_packets",
    "Subflow Bwd Byts": "dst2src_bytes",
    "Init Fwd Win Byts": "src2dst_init_win_bytes",
    "Init Bwd Win Byts": "dst2src_init_win_bytes",
    "Active Mean": "active_mean",
    "Active Std": "active_stddev",
    "Active Max": "active_max",
    "Active Min": "active_min",
    "Idle Mean": "idle_mean",
    "Idle Std": "idle_stddev",
    "Idle Max": "idle_max",
    "Idle Min": "idle_min",
}

# Columns a rule may read a rule input from, in order of preference,
# after the feature column itself.
RULE_INPUT_ALIASES: dict[str, tuple[str, ...]] = {
    "Tot Fwd Pkts": ("src2dst_packets",),
    "Tot Bwd Pkts": ("dst2src_packets",),
    "TotLen Fwd Pkts": ("src2dst_bytes",),
    "TotLen Bwd Pkts": ("dst2src_bytes",),
    "SYN Flag Cnt": ("bidirectional_syn_packets",),
    "FIN Flag Cnt": ("bidirectional_fin_packets",),
    "PSH Flag Cnt": ("bidirectional_psh_packets", "Fwd PSH Flags", "src2dst_psh_packets"),
    "URG Flag Cnt": ("bidirectional_urg_packets", "Fwd URG Flags", "src2dst_urg_packets"),
    "Flow Duration": ("bidirectional_duration_ms",),
    "Dst Port": ("dst_port",),
    "Protocol": ("protocol",),
}

# Columns of the raw day files that are not features.
LABEL = "Label"
BENIGN = "Benign"
IDENTITY_COLUMNS: tuple[str, ...] = ("Flow ID", "Src IP", "Dst IP", "Src Port")
TIMESTAMP_COLUMNS: tuple[str, ...] = ("Timestamp",)
ZERO_BULK_COLUMNS: tuple[str, ...] = (
    "Fwd Byts/b Avg",
    "Fwd Pkts/b Avg",
    "Fwd Blk Rate Avg",
    "Bwd Byts/b Avg",
    "Bwd Pkts/b Avg",
    "Bwd Blk Rate Avg",
)

# Verdict levels and the action taken for each.
SEVERITY: dict[str, int] = {"BENIGN": 0, "ANOMALY": 1, "SUSPECT": 2, "ATTACK": 3}
ACTIONS: dict[str, str] = {
    "ATTACK": "block",
    "SUSPECT": "alert",
    "ANOMALY": "rate_limit+alert",
    "BENIGN": "pass",
}

# Alert label shown for a fired rule.
RULE_LABELS: dict[str, str] = {
    "_rule_brute_force": "Brute Force",
    "_rule_slowloris": "DoS attacks-Slowloris",
    "_rule_syn_flood": "SYN Flood",
    "_rule_portscan": "Port Scan",
    "_rule_icmp_flood": "ICMP Flood",
    "_rule_empty_udp_probe": "UDP Probe",
    "_rule_web_scanner": "Web Scanner",
    "_rule_injection_tool": "Injection Attack",
    "_rule_http_probe": "HTTP Probe",
}

META_COLUMNS: tuple[str, ...] = (
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time_ms", "end_time_ms",
)

FEATURE_SCHEMA = T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES])
