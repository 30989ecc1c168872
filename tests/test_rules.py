"""Golden rule and fusion cases, thresholds at their boundaries, upgrade-only invariant."""

import random

import pytest
from pyspark.sql import functions as F

from flowwarden.config import DetectionConfig
from flowwarden.functions.numeric import half_even
from flowwarden.operators.fusion import fuse
from flowwarden.operators.rules import Rule, apply_rules, explain_rules
from flowwarden.plans.scoring import score_flows
from flowwarden.schema import FEATURES, METER_COLUMNS, SEVERITY

COLUMNS = [
    "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "SYN Flag Cnt", "FIN Flag Cnt", "PSH Flag Cnt", "URG Flag Cnt",
]


def flows(spark, rows, columns=tuple(COLUMNS)):
    """rows: (name, {feature: value}, port, protocol)"""
    schema = "name string, dst_port int, protocol int, verdict string, source string, " + ", ".join(f"`{c}` double" for c in columns)
    data = [(n, port, proto, "BENIGN", "RF+AE", *[float(f.get(c, 0.0)) for c in columns]) for n, f, port, proto in rows]
    return spark.createDataFrame(data, schema)


def run(spark, rows, columns=tuple(COLUMNS)):
    out = apply_rules(flows(spark, rows, columns)).collect()
    return {r["name"]: (r["verdict"], r["source"], [f.split(":")[0] for f in r["heuristic_flags"]]) for r in out}


def f(syn=0, fin=0, psh=0, urg=0, fwd=0, bwd=0, fb=0, bb=0, dur=0):
    return {
        "SYN Flag Cnt": syn, "FIN Flag Cnt": fin, "PSH Flag Cnt": psh, "URG Flag Cnt": urg, "Tot Fwd Pkts": fwd,
        "Tot Bwd Pkts": bwd, "TotLen Fwd Pkts": fb, "TotLen Bwd Pkts": bb, "Flow Duration": dur,
    }


def test_schema():
    assert len(FEATURES) == 72 and len(set(FEATURES)) == 72
    assert len(METER_COLUMNS) == 61 and set(METER_COLUMNS) < set(FEATURES)


def test_one_flow_per_rule(spark):
    """Each flow is built from the definition of one rule, well inside its thresholds, and fires no other."""
    got = run(spark, [
        ("many logins", f(syn=12, fwd=33, bwd=17, fb=2_600, bb=900), 3389, 6),
        ("held open", f(dur=55_000_000, fwd=11, bwd=9, fb=700, bb=450), 8080, 6),
        ("half open", f(syn=60, fwd=61, fb=90_000), 5000, 6),
        ("knocking", f(syn=7, fwd=3, bwd=9, fb=100, bb=50), 5000, 6),
        ("echo storm", f(fwd=340, bwd=120, fb=9_000), 0, 1),
        ("blank datagrams", f(fwd=3), 40_000, 17),
        ("urgent crawl", f(dur=2_000_000, fwd=70, bwd=30, urg=21, fb=50_000, bb=90_000), 443, 6),
        ("pushed forms", f(fwd=21, bwd=9, psh=24, fb=8_000, bb=7_000), 8080, 6),
        ("idle knock", f(dur=4_000_000, fwd=2, bwd=1, fb=90, bb=60), 443, 6),
        ("page view", f(dur=640_000, fwd=14, bwd=23, fb=3_100, bb=61_000, psh=7, fin=2), 443, 6),
        ("two echoes", f(fwd=2, bwd=2), 0, 1),
    ])
    one = {
        "many logins": ("ATTACK", "brute_force"), "held open": ("ATTACK", "slowloris"), "half open": ("SUSPECT", "syn_flood"),
        "knocking": ("SUSPECT", "portscan"), "echo storm": ("SUSPECT", "icmp_flood"), "blank datagrams": ("SUSPECT", "empty_udp_probe"),
        "urgent crawl": ("SUSPECT", "web_scanner"), "pushed forms": ("SUSPECT", "injection_tool"), "idle knock": ("SUSPECT", "http_probe"),
    }
    want = {name: (verdict, f"HEUR:_rule_{rule}", [f"_rule_{rule}"]) for name, (verdict, rule) in one.items()}
    assert got == {**want, "page view": ("BENIGN", "RF+AE", []), "two echoes": ("BENIGN", "RF+AE", [])}


def test_boundaries(spark):
    eps = 1e-9
    got = run(spark, [
        ("brute at", f(syn=8, fwd=10, fb=1499), 22, 6),
        ("brute size", f(syn=8, fwd=10, fb=1500), 22, 6),
        ("brute syn", f(syn=7, fwd=10, fb=10), 22, 6),
        ("slow at", f(dur=10_000_000, fwd=30, fb=2000), 443, 6),
        ("slow rate", f(dur=10_000_000, fwd=30, fb=2001), 443, 6),
        ("slow packets", f(dur=10_000_000, fwd=31, fb=600), 443, 6),
        ("slow fin", f(dur=10_000_000, fwd=30, fb=2000, fin=1), 443, 6),
        ("syn at", f(syn=9, fwd=10, fb=1e6), 99, 6),
        ("syn below", f(syn=9 - eps, fwd=10, fb=1e6), 99, 6),
        ("probe low", f(dur=500_000, fwd=3, fb=25), 80, 6),
        ("probe short", f(dur=499_999, fwd=3, fb=20), 80, 6),
        ("icmp at", f(fwd=50), 0, 1),
        ("icmp below", f(fwd=49), 0, 1),
        ("udp at", f(fwd=1, fb=10), 9999, 17),
        ("udp above", f(fwd=1, fb=11), 9999, 17),
        ("udp dns", f(fwd=1, fb=10), 53, 17),
        ("psh at", f(fwd=10, psh=6, fb=1e6), 8080, 6),
        ("psh few", f(fwd=5, psh=5, fb=1e6), 8080, 6),
        ("scan at", f(fwd=4, syn=5, fb=199, bwd=10), 9999, 6),
        ("scan size", f(fwd=4, syn=5, fb=200, bwd=10), 9999, 6),
        ("urg at", f(fwd=20, urg=1, dur=1_000_000, fb=1e6), 80, 6),
        ("urg slow", f(fwd=20, urg=1, dur=1_000_001, fb=1e6), 80, 6),
    ])
    fired = {name for name, (_, _, flags) in got.items() if flags}
    assert fired == {
        "brute at", "slow at", "syn at", "probe low", "icmp at", "udp at", "psh at", "scan at", "urg at",
    }


def test_aliases_and_bad_numbers(spark):
    raw = ("bidirectional_syn_packets", "src2dst_packets", "dst2src_packets", "src2dst_bytes", "dst2src_bytes")
    row = dict(zip(raw, (31, 44, 12, 1_500, 640)))
    assert run(spark, [("raw", row, 21, 6)], raw)["raw"][0] == "ATTACK"
    both = ("SYN Flag Cnt", *raw)
    assert run(spark, [("nan", {**row, "SYN Flag Cnt": float("nan")}, 21, 6)], both)["nan"][0] == "ATTACK"
    assert run(spark, [("inf", {**row, "SYN Flag Cnt": float("inf")}, 21, 6)], both)["inf"][0] == "ATTACK"


@pytest.mark.parametrize("attack,conf,flagged,score,expected", [
    (False, 0.1, False, 5.0, ("ATTACK", "AE_HARD")),
    (True, 0.70, False, 0.1, ("ATTACK", "RF")),
    (True, 0.69, True, 1.0, ("ATTACK", "RF+AE")),
    (True, 0.69, False, 0.1, ("SUSPECT", "RF")),
    (False, 0.9, True, 1.0, ("ANOMALY", "AE")),
    (False, 0.9, False, 0.1, ("BENIGN", "RF+AE")),
])
def test_fusion_rows(spark, attack, conf, flagged, score, expected):
    verdict, source = fuse(F.lit(attack), F.lit(conf), F.lit(flagged), F.lit(score))
    assert tuple(spark.range(1).select(verdict, source).first()) == expected


def test_user_rules_in_any_order_follow_the_sequential_fold(spark):
    names = [("a", "SUSPECT", 1), ("b", "ANOMALY", 2), ("c", "ATTACK", 4), ("d", "ATTACK", 8)]
    rows = [(str(bits), {"Tot Fwd Pkts": bits}, 0, 0) for bits in range(16)]
    df = flows(spark, rows)
    for incoming in SEVERITY:
        rules = [
            Rule(n, level, F.col("in_fwd").cast("int").bitwiseAND(bit) > 0, F.lit(n)) for n, level, bit in names
        ]
        out = apply_rules(df.withColumn("verdict", F.lit(incoming)), rules=rules).collect()
        for r in out:
            verdict, source = incoming, "RF+AE"
            for n, level, bit in names:
                if int(r["name"]) & bit and SEVERITY[level] > SEVERITY[verdict]:
                    verdict, source = level, f"HEUR:_rule_{n}"
            assert (r["verdict"], r["source"]) == (verdict, source)
            assert SEVERITY[r["verdict"]] >= SEVERITY[incoming]


def test_master_switch_and_explain(spark):
    df = flows(spark, [("flood", f(fwd=500, bwd=500), 0, 1)])
    off = apply_rules(df, DetectionConfig(rules_enabled=False)).first()
    assert off["verdict"] == "BENIGN" and off["heuristic_flags"] == []
    report = {r["rule"]: r for r in explain_rules(df, ["name"]).collect()}
    assert len(report) == 9 and report["_rule_icmp_flood"]["detail"] == "icmp_flood(pkts=1000)"
    assert [n for n, r in report.items() if r["fired"]] == ["_rule_icmp_flood"]


def test_scoring_keeps_rows_and_skips_whitelisted(spark):
    df = flows(spark, [("a", f(fwd=500, bwd=500), 0, 1), ("b", f(fwd=500, bwd=500), 67, 1), ("c", {}, None, None)])
    df = df.drop("verdict", "source").withColumns({
        "src_ip": F.lit("10.0.0.1"), "dst_ip": F.lit("10.0.0.2"), "rf_label": F.lit("Benign"),
        "rf_confidence": F.lit(0.9), "ae_score": F.lit(0.1),
    })
    got = {r["name"]: r for r in score_flows(df).collect()}
    assert got["a"]["verdict"] == "SUSPECT" and got["a"]["action"] == "alert"
    assert (got["b"]["verdict"], got["b"]["source"], got["b"]["confidence"], got["b"]["heuristic_flags"]) == ("BENIGN", "WHITELIST", 1.0, [])
    assert got["c"]["verdict"] == "BENIGN" and len(got) == 3


def test_texts_round_exact_values_half_to_even(spark):
    rng = random.Random(0)
    values = [0.125, 0.375, 0.165, 0.145, 0.155, 2.5, 3.5, 0.5, -0.125, -2.5, 1.005, 1e15, 0.0, 0.045, 8.345]
    values += [rng.randrange(20_000) / rng.choice([8, 16, 40, 200, 2000]) for _ in range(3_000)] + [rng.random() * 1e6 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", *[F.format_string(f"%.{d}f", half_even(F.col("x"), d)).alias(f"t{d}") for d in range(4)]).collect()
    assert [tuple(r) for r in got] == [(v, *(f"{v:.{d}f}" for d in range(4))) for v in values]
