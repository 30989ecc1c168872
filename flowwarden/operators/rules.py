"""Detection rules as Column expressions, and the upgrade-only fold over them.

A rule is a name, the verdict level it asks for, a boolean Column and a text
Column. Rules read the ``in_*`` columns added by :func:`with_rule_inputs`, so a
user rule is written the same way as a built-in one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, DetectionConfig
from ..functions.numeric import col, compute_once, finite_column, half_even, ratio
from ..functions.verdicts import severity
from ..schema import RULE_INPUT_ALIASES, SEVERITY

RULE_PREFIX = "_rule_"


@dataclass(frozen=True)
class Rule:
    name: str
    level: str
    condition: Column
    text: Column
    numbers: dict[str, Column] = field(default_factory=dict)

    @property
    def full_name(self) -> str:
        return RULE_PREFIX + self.name

    @property
    def full_text(self) -> Column:
        return F.concat(F.lit(self.full_name + ":"), self.text)

    @property
    def flag(self) -> Column:
        """Flag text of the rule where it fires, else NULL."""
        return F.when(self.condition, self.full_text)


def resolve_input(df: DataFrame, key: str) -> Column:
    """First finite value among the feature column and its aliases, else 0.

    The duration alias is in milliseconds, the feature in microseconds.
    """
    candidates = []
    for name in (key, *RULE_INPUT_ALIASES.get(key, ())):
        if name in df.columns:
            value = finite_column(df, name)
            candidates.append(value * 1000.0 if name == "bidirectional_duration_ms" else value)
    return F.coalesce(*candidates, F.lit(0.0))


def _nonzero_int(df: DataFrame, meta: str, feature: str, default: int) -> Column:
    """Integer part of the first non-zero value of the meta column and the feature."""
    found = []
    for name in (meta, feature):
        if name in df.columns:
            value = finite_column(df, name).try_cast("int")
            found.append(F.when(value != 0, value))
    return F.coalesce(*found, F.lit(default))


def flow_port(df: DataFrame) -> Column:
    return _nonzero_int(df, "dst_port", "Dst Port", 0)


def flow_protocol(df: DataFrame, default: int = 0) -> Column:
    return _nonzero_int(df, "protocol", "Protocol", default)


INPUT_COLUMNS = (
    "in_fwd", "in_bwd", "in_fwd_bytes", "in_bwd_bytes", "in_syn", "in_fin", "in_psh", "in_urg",
    "in_duration_s", "in_port", "in_protocol", "in_packets", "in_bytes",
    "in_syn_share", "in_psh_share", "in_urg_share", "in_packet_size", "in_byte_rate", "in_packet_rate",
)


def with_rule_inputs(df: DataFrame) -> DataFrame:
    """Add the resolved rule inputs, totals and rates as ``in_*`` columns.

    They are added in layers of small projections: a column used several times
    above stays its own projection, which keeps the generated code of each one
    short enough for the JIT compiler.
    """
    base = df.withColumns({
        "in_fwd": resolve_input(df, "Tot Fwd Pkts"),
        "in_bwd": resolve_input(df, "Tot Bwd Pkts"),
        "in_fwd_bytes": resolve_input(df, "TotLen Fwd Pkts"),
        "in_bwd_bytes": resolve_input(df, "TotLen Bwd Pkts"),
        "in_syn": resolve_input(df, "SYN Flag Cnt"),
        "in_fin": resolve_input(df, "FIN Flag Cnt"),
        "in_psh": resolve_input(df, "PSH Flag Cnt"),
        "in_urg": resolve_input(df, "URG Flag Cnt"),
        "in_duration_s": resolve_input(df, "Flow Duration") / 1_000_000.0,
        "in_port": flow_port(df),
        "in_protocol": flow_protocol(df, default=-1),
    })
    totals = base.withColumns({
        "in_packets": F.col("in_fwd") + F.col("in_bwd"),
        "in_bytes": F.col("in_fwd_bytes") + F.col("in_bwd_bytes"),
    })
    packets, size, seconds = F.col("in_packets"), F.col("in_bytes"), F.col("in_duration_s")
    return totals.withColumns({
        "in_syn_share": ratio(F.col("in_syn"), packets),
        "in_psh_share": ratio(F.col("in_psh"), packets),
        "in_urg_share": ratio(F.col("in_urg"), packets),
        "in_packet_size": ratio(size, packets),
        "in_byte_rate": ratio(size, seconds),
        "in_packet_rate": ratio(packets, seconds),
    })


def _text(template: str, *values: Column) -> Column:
    """``template`` filled; numbers with ``%.<digits>f`` are rounded half to even on their exact value."""
    places = re.findall(r"%(?:\.(\d)f|d)", template)
    return F.format_string(template, *[half_even(v, int(p)) if p else v for v, p in zip(values, places, strict=True)])


def built_in_rules(cfg: DetectionConfig = DEFAULT) -> list[Rule]:
    """The nine built-in rules, in evaluation order."""
    c = F.col
    fwd, packets, size = c("in_fwd"), c("in_packets"), c("in_bytes")
    syn, fin = c("in_syn"), c("in_fin")
    seconds, port, protocol = c("in_duration_s"), c("in_port"), c("in_protocol")
    web = port.isin(*cfg.web_ports)
    syn_share, psh_share, urg_share = c("in_syn_share"), c("in_psh_share"), c("in_urg_share")
    packet_size, byte_rate, packet_rate = c("in_packet_size"), c("in_byte_rate"), c("in_packet_rate")

    def whole(x: Column) -> Column:
        return F.coalesce(x.try_cast("bigint"), F.lit(0))

    # Names, levels and flag texts.
    return [
        Rule(
            "brute_force", "ATTACK",
            port.isin(*cfg.brute_force_ports) & (syn >= cfg.brute_min_syns) & (packet_size < 150),
            _text("brute_force(port=%d, syns=%d, mean_pkt=%.0fB)", port, whole(syn), packet_size),
            {"port": port, "syns": syn, "mean_pkt": packet_size},
        ),
        Rule(
            "slowloris", "ATTACK",
            web & (seconds >= cfg.slowloris_min_duration_s) & (byte_rate <= cfg.slowloris_max_bps)
            & (packets <= cfg.slowloris_max_packets) & (fin == 0),
            _text("slowloris(dur=%.1fs, bps=%.1f, pkts=%d, fin=%d)", seconds, byte_rate, whole(packets), whole(fin)),
            {"dur": seconds, "bps": byte_rate, "pkts": packets, "fin": fin},
        ),
        Rule(
            "syn_flood", "SUSPECT",
            (packets >= 2) & (syn_share >= cfg.syn_flood_ratio) & (syn >= 2),
            _text("syn_flood(ratio=%.2f, syns=%d)", syn_share, whole(syn)),
            {"ratio": syn_share, "syns": syn},
        ),
        Rule(
            "portscan", "SUSPECT",
            (fwd <= 4) & (syn >= cfg.portscan_syns) & (size < 200),
            _text("portscan(fwd_pkts=%d, syns=%d, bytes=%d)", whole(fwd), whole(syn), whole(size)),
            {"fwd_pkts": fwd, "syns": syn, "bytes": size},
        ),
        Rule(
            "icmp_flood", "SUSPECT",
            (protocol == 1) & (packets >= cfg.icmp_min_packets),
            _text("icmp_flood(pkts=%d)", whole(packets)),
            {"pkts": packets},
        ),
        Rule(
            "empty_udp_probe", "SUSPECT",
            (protocol == 17) & ~port.isin(*cfg.udp_service_ports)
            & (size <= cfg.empty_udp_max_bytes) & (c("in_bwd") == 0),
            _text("empty_udp_probe(bytes=%d, bwd_pkts=0)", whole(size)),
            {"bytes": size},
        ),
        Rule(
            "web_scanner", "SUSPECT",
            web & (seconds > 0) & (packet_rate >= cfg.scanner_min_pps) & (urg_share >= cfg.scanner_urg_ratio),
            _text("web_scanner(pps=%.1f, urg_ratio=%.3f)", packet_rate, urg_share),
            {"pps": packet_rate, "urg_ratio": urg_share},
        ),
        Rule(
            "injection_tool", "SUSPECT",
            web & (packets >= 6) & (psh_share >= cfg.injection_psh_ratio),
            _text("injection_tool(psh_ratio=%.2f, pkts=%d)", psh_share, whole(packets)),
            {"psh_ratio": psh_share, "pkts": packets},
        ),
        Rule(
            "http_probe", "SUSPECT",
            web & (seconds >= 0.5) & (seconds < cfg.slowloris_min_duration_s)
            & (byte_rate <= cfg.http_probe_max_bps) & (size < 500),
            _text("http_probe(bps=%.1f, bytes=%d, dur=%.2fs)", byte_rate, whole(size), seconds),
            {"bps": byte_rate, "bytes": size, "dur": seconds},
        ),
    ]


def fired_flags(rules: Sequence[Rule]) -> Column:
    """Flag texts of all fired rules, in rule order.

    One array per fired rule, put together: a lambda over all texts would have every condition and text interpreted for every row.
    """
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(r.condition & r.text.isNotNull(), F.array(r.full_text)).otherwise(none) for r in rules]) if rules else none


def first_fired(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that fires, else NULL."""
    name = F
    for rule in rules:
        name = name.when(rule.condition, F.lit(rule.full_name))
    return name.otherwise(F.lit(None).cast("string"))


def fold_verdict(df: DataFrame, rules: Sequence[Rule], guard: Column | None = None) -> DataFrame:
    """Replace ``verdict`` and ``source`` by their values after all rules and add ``rule_fired``.

    A verdict only ever moves up. Going through the rules one by one, the last one that raises the verdict is
    the first fired rule of the highest fired level, so one CASE over the levels
    decides, for any rule order.
    """
    levels = sorted({r.level for r in rules}, key=lambda level: -SEVERITY[level])
    if not levels:
        return df.withColumn("rule_fired", F.lit(False))
    helper = {level: f"rule_{level.lower()}" for level in levels}
    named = {}
    for level, name in helper.items():
        fired = first_fired([r for r in rules if r.level == level])
        named[name] = fired if guard is None else F.when(guard, fired)
    found = df.withColumns({**named, "level_in": severity(F.col("verdict"))})
    verdict = source = F
    for level, name in helper.items():
        raises = (F.col("level_in") < SEVERITY[level]) & F.col(name).isNotNull()
        verdict = verdict.when(raises, F.lit(level))
        source = source.when(raises, F.concat(F.lit("HEUR:"), name))
    judged = compute_once(found, {
        "verdict": verdict.otherwise(F.col("verdict")),
        "source": source.otherwise(F.col("source")),
        "rule_fired": F.coalesce(*[F.col(name) for name in helper.values()]).isNotNull(),
    })
    return judged.drop(*helper.values(), "level_in")


def apply_rules(
    df: DataFrame,
    cfg: DetectionConfig = DEFAULT,
    rules: Sequence[Rule] | None = None,
    guard: Column | None = None,
) -> DataFrame:
    """Upgrade ``verdict``/``source``, add ``rule_fired`` and ``heuristic_flags``; rows where ``guard`` is false are left alone.

    The flag texts are computed only where a later step reads them.
    """
    rules = built_in_rules(cfg) if rules is None else list(rules)
    if not cfg.rules_enabled:
        off = {"rule_fired": F.lit(False), "heuristic_flags": F.array().cast("array<string>")}
        return df.withColumns(off).drop(*INPUT_COLUMNS)
    ready = df if "in_packets" in df.columns else with_rule_inputs(df)
    flags = fired_flags(rules)
    if guard is not None:
        flags = F.when(guard, flags).otherwise(F.array().cast("array<string>"))
    return fold_verdict(ready, rules, guard).withColumn("heuristic_flags", flags).drop(*INPUT_COLUMNS)


def explain_rules(
    df: DataFrame, keys: Sequence[str], cfg: DetectionConfig = DEFAULT, rules: Sequence[Rule] | None = None
) -> DataFrame:
    """One row per flow and rule: rule, fired, verdict, detail."""
    rules = built_in_rules(cfg) if rules is None else list(rules)
    entries = [
        F.struct(
            F.lit(r.full_name).alias("rule"),
            r.condition.alias("fired"),
            F.when(r.condition, F.lit(r.level)).alias("verdict"),
            F.when(r.condition, r.text).alias("detail"),
        )
        for r in rules
    ]
    return (
        with_rule_inputs(df)
        .select(*[col(k) for k in keys], F.explode(F.array(*entries)).alias("e"))
        .select(*[col(k) for k in keys], "e.rule", "e.fired", "e.verdict", "e.detail")
    )


def rule_numbers(df: DataFrame, keys: Sequence[str], rule: Rule) -> DataFrame:
    """The numbers a rule reports, for the flows it fires on."""
    return (
        with_rule_inputs(df).filter(rule.condition)
        .select(*[col(k) for k in keys], *[v.cast("double").alias(k) for k, v in rule.numbers.items()])
    )


def rule_inputs_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per flow and rule input: the resolved value of each of the 11 keys."""
    resolved = F.create_map(*[x for k in RULE_INPUT_ALIASES for x in (F.lit(k), resolve_input(df, k))])
    return df.select(*[col(k) for k in keys], F.explode(resolved).alias("key", "value"))
