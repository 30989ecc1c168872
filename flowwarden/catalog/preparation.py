"""Queries over sources, cleaning, features, sampling, encoding and scaling."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators.cleaning import (
    attack_rows, benign_rows, class_pair, clean, drop_identity, drop_repeated_headers, drop_zero_bulk,
    fill_missing, fill_non_finite, force_numeric, load_ready, trim_labels, trim_names,
)
from ..operators.encoding import encode_labels, fit_labels
from ..operators.features import feature_vector, flow_features, flow_meta
from ..operators.sampling import cap_benign, mark_test, sample_rows
from ..operators.scaling import fit_scaler, scale
from ..schema import BENIGN, FEATURES, METER_COLUMNS
from ..session import scratch_path
from ..sources.day_files import file_headers, header_profile, read_day_files
from ..sources.tables import dataset_summary, feature_table, read_table, write_json, write_tables
from .registry import query
from .views import KEYS, WITH_FLOWS, WITH_RAW, duck, flows, raw_flows, table

_K = ", ".join(KEYS)
_NUM = ("Dst Port", "Tot Fwd Pkts", "TotLen Fwd Pkts", "Flow Byts/s", "SYN Flag Cnt")
# Numeric text in the oracle: same pattern as the engine, then a cast that cannot fail.
_NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim(\"{c}\"), '{_NUM_RE}') THEN TRY_CAST(trim(\"{c}\") AS DOUBLE) END"


def _clean(c: str) -> str:
    return f"CASE WHEN isfinite({_num(c)}) THEN {_num(c)} ELSE 0 END"


def _day_files(spark, sf_dir):
    """The raw view written as day files: blank-padded names, one file set with identity columns."""
    root = scratch_path(spark, "days")
    raw = raw_flows(spark, sf_dir)
    padded = {c: f" {c} " for c in raw.columns if c not in ("source_file", "Label")}
    plain = raw.filter("source_file <> 'day1.csv'").withColumnsRenamed(padded)
    extra = raw.filter("source_file = 'day1.csv'").select(
        F.lit("f").alias("Flow ID"), F.lit("10.0.0.1").alias("Src IP"), F.lit("10.0.0.2").alias("Dst IP"),
        F.lit("1").alias("Src Port"), "*",
    )
    for frame, where in ((plain, "a"), (extra, "b")):
        frame.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).partitionBy("source_file").csv(f"{root}/{where}")
    return root


def _scan(spark, sf_dir):
    return read_day_files(spark, _day_files(spark, sf_dir))


_SCAN_COLS = ("Dst Port", "Tot Fwd Pkts", "TotLen Fwd Pkts", "Flow Byts/s", "SYN Flag Cnt", "Fwd Byts/b Avg", "Timestamp", "Label")


@query("s01_scan_day_files", f"""{WITH_RAW}
SELECT {", ".join(f'"{c}"' for c in _SCAN_COLS)}, source_file = 'day1.csv' AS has_identity, count(*) AS n
FROM raw_flows_v GROUP BY ALL""")
def s01(spark, sf_dir):
    df = _scan(spark, sf_dir)
    return df.groupBy(*[col(c) for c in _SCAN_COLS], F.col("Flow ID").isNotNull().alias("has_identity")).agg(
        F.count("*").alias("n")
    )


@query("s02_trimmed_names", f"""{WITH_RAW}
SELECT "Dst Port", "Label", count(*) AS n FROM raw_flows_v GROUP BY ALL""")
def s02(spark, sf_dir):
    raw = raw_flows(spark, sf_dir)
    return trim_names(raw.toDF(*[f"  {c} " for c in raw.columns])).groupBy(col("Dst Port"), "Label").agg(F.count("*").alias("n"))


@query("s03_header_profile", f"""{WITH_RAW}, h AS (SELECT DISTINCT source_file = 'day1.csv' AS b FROM raw_flows_v)
SELECT b AS has_identity, CASE WHEN b THEN 12 ELSE 8 END AS n_columns, 'Label' AS label_candidate FROM h""")
def s03(spark, sf_dir):
    profile = header_profile(file_headers(spark, _day_files(spark, sf_dir)))
    return profile.select(
        (F.col("n_columns") == 12).alias("has_identity"), "n_columns",
        F.element_at("label_candidates", 1).alias("label_candidate"),
    ).distinct()


@query("s04_union_files", f"{WITH_RAW} SELECT source_file = 'day1.csv' AS has_identity, count(*) AS n FROM raw_flows_v GROUP BY ALL")
def s04(spark, sf_dir):
    return _scan(spark, sf_dir).groupBy(F.col("Src IP").isNotNull().alias("has_identity")).agg(F.count("*").alias("n"))


@query("u01_union_by_name", f"""{WITH_RAW}
SELECT "Label", "Dst Port", source_file = 'day1.csv' AS b, count(*) AS n FROM raw_flows_v WHERE source_file IN ('day1.csv','day2.csv') GROUP BY ALL""")
def u01(spark, sf_dir):
    raw = raw_flows(spark, sf_dir)
    a = raw.filter("source_file = 'day1.csv'").select("Label", "Dst Port", F.lit(True).alias("b"))
    b = raw.filter("source_file = 'day2.csv'").select("Dst Port", "Label")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("Label", "Dst Port", F.coalesce("b", F.lit(False)).alias("b")).agg(F.count("*").alias("n"))


@query("p01_trim_labels", f"""{WITH_RAW}
SELECT coalesce(trim("Label"), 'nan') AS label, count(*) AS n FROM raw_flows_v GROUP BY ALL""")
def p01(spark, sf_dir):
    return trim_labels(raw_flows(spark, sf_dir)).groupBy(col("Label").alias("label")).agg(F.count("*").alias("n"))


@query("p02_drop_identity", f"""{WITH_RAW}
SELECT "Dst Port", "Label", "Fwd Byts/b Avg" AS bulk, count(*) AS n FROM raw_flows_v GROUP BY ALL""")
def p02(spark, sf_dir):
    df = drop_identity(raw_flows(spark, sf_dir))
    assert "Timestamp" not in df.columns
    return df.groupBy(col("Dst Port"), "Label", col("Fwd Byts/b Avg").alias("bulk")).agg(F.count("*").alias("n"))


@query("p03_drop_zero_bulk", f"""{WITH_RAW}
SELECT column_name, n FROM (SELECT unnest(['source_file','Dst Port','Tot Fwd Pkts','TotLen Fwd Pkts','Flow Byts/s','SYN Flag Cnt','Timestamp','Label'])
  AS column_name), (SELECT count(*) AS n FROM raw_flows_v)""")
def p03(spark, sf_dir):
    df = drop_zero_bulk(raw_flows(spark, sf_dir))
    return df.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("column_name"), "n")


@query("p04_force_numeric", f"""{WITH_RAW}
SELECT {", ".join(f'{_num(c)} AS "{c}"' for c in _NUM)} FROM raw_flows_v""")
def p04(spark, sf_dir):
    return force_numeric(raw_flows(spark, sf_dir), _NUM).select(*[col(c) for c in _NUM])


@query("p05_fill_missing", f"""{WITH_RAW}, n AS (SELECT {_num("Flow Byts/s")} AS x FROM raw_flows_v)
SELECT CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END AS x, count(*) AS n FROM n GROUP BY ALL""")
def p05(spark, sf_dir):
    df = fill_missing(force_numeric(raw_flows(spark, sf_dir), ["Flow Byts/s"]), ["Flow Byts/s"])
    return df.groupBy(col("Flow Byts/s").alias("x")).agg(F.count("*").alias("n"))


@query("p06_fill_non_finite", f"""{WITH_RAW}
SELECT {", ".join(f'{_clean(c)} AS "{c}"' for c in _NUM)} FROM raw_flows_v""")
def p06(spark, sf_dir):
    return fill_non_finite(force_numeric(raw_flows(spark, sf_dir), _NUM), _NUM).select(*[col(c) for c in _NUM])


_CLEAN_SQL = f"""{WITH_RAW}, cleaned AS (SELECT source_file, trim("Label") AS label,
  {", ".join(f'{_clean(c)} AS "{c}"' for c in _NUM)} FROM raw_flows_v WHERE trim("Label") <> 'Label')"""


@query("p06_clean_job", f'{_CLEAN_SQL} SELECT label AS "Label", source_file, {", ".join(chr(34) + c + chr(34) for c in _NUM)} FROM cleaned')
def clean_job(spark, sf_dir):
    return clean(load_ready(raw_flows(spark, sf_dir)))


@query("p07_safe_default", f"""{WITH_RAW}, n AS (SELECT {_num("SYN Flag Cnt")} AS x FROM raw_flows_v)
SELECT CASE WHEN isfinite(x) THEN x ELSE -1 END AS x, count(*) AS n FROM n GROUP BY ALL""")
def p07(spark, sf_dir):
    df = fill_non_finite(force_numeric(raw_flows(spark, sf_dir), ["SYN Flag Cnt"]), ["SYN Flag Cnt"], -1.0)
    return df.groupBy(col("SYN Flag Cnt").alias("x")).agg(F.count("*").alias("n"))


@query("f01_repeated_headers", f"""{WITH_RAW} SELECT trim("Label") AS label, count(*) AS n FROM raw_flows_v WHERE trim("Label") <> 'Label' GROUP BY ALL""")
def f01(spark, sf_dir):
    return drop_repeated_headers(trim_labels(raw_flows(spark, sf_dir))).groupBy(col("Label").alias("label")).agg(F.count("*").alias("n"))


@query("f02_benign_attack", f"""{WITH_FLOWS}
SELECT label = 'Benign' AS benign, count(*) AS n, round(avg(ae_score), 6) AS score FROM flows_v GROUP BY ALL""")
def f02(spark, sf_dir):
    df = flows(spark, sf_dir)
    parts = [
        (True, benign_rows(df, "label")), (False, attack_rows(df, "label")),
    ]
    out = [
        p.agg(F.count("*").alias("n"), F.round(F.avg("ae_score"), 6).alias("score")).select(F.lit(b).alias("benign"), "*")
        for b, p in parts
    ]
    return out[0].unionByName(out[1])


@query("f05_class_pair", f"{WITH_FLOWS} SELECT {_K}, label FROM flows_v WHERE label IN ('Bot','SSH-Bruteforce')")
def f05(spark, sf_dir):
    return class_pair(flows(spark, sf_dir), "Bot", "SSH-Bruteforce", "label").select(*KEYS, "label")


# ---- flow-meter records derived from lineitem: every meter column a different integer mix
_METER = sorted({*METER_COLUMNS.values(), "bidirectional_bytes", "bidirectional_packets"})
_METER_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"CASE WHEN (l_partkey + {i}) % 71 = 0 THEN CAST('NaN' AS DOUBLE) WHEN (l_suppkey + {i}) % 67 = 0 THEN NULL "
    f"ELSE CAST((l_partkey * {i + 3} + l_suppkey * {2 * i + 1} + l_orderkey * 7) % {50 + 13 * i} AS DOUBLE) END AS {name}"
    for i, name in enumerate(_METER)
) + """, CAST((l_orderkey % 41) * 500 AS DOUBLE) AS bidirectional_duration_ms, CAST(l_orderkey * 250 AS DOUBLE) + 0.75E0 AS bidirectional_first_seen_ms,
  CAST(l_orderkey * 250 + 9 AS DOUBLE) AS bidirectional_last_seen_ms, CAST(l_partkey % 65536 AS DOUBLE) AS dst_port,
  CAST(1024 + l_orderkey % 50000 AS DOUBLE) AS src_port, CAST(CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 6 END AS DOUBLE) AS protocol,
  '10.0.0.1' AS src_ip, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE '10.0.0.2' END AS dst_ip FROM lineitem"""
WITH_METER = f"WITH meter AS ({duck(_METER_SQL)})"


def meter(spark, sf_dir):
    return spark.sql(_METER_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def _fin(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} ELSE 0 END"


@query("p10_renamed_features", f"""{WITH_METER} SELECT {_K}, {", ".join(f'{_fin(s)} AS "{f}"' for f, s in METER_COLUMNS.items())} FROM meter""")
def p10(spark, sf_dir):
    return flow_features(meter(spark, sf_dir), KEYS).select(*KEYS, *[col(f) for f in METER_COLUMNS])


_SECS = "(bidirectional_duration_ms / 1000.0E0)"


def _rate(c: str) -> str:
    return f"CASE WHEN {_SECS} > 0 THEN round(({_fin(c)}) / {_SECS}, 6) ELSE 0 END"


@query("p11_computed_features", f"""{WITH_METER} SELECT {_K}, {_fin("dst_port")} AS "Dst Port", {_fin("protocol")} AS "Protocol",
  bidirectional_duration_ms * 1000 AS "Flow Duration", {_rate("bidirectional_bytes")} AS "Flow Byts/s",
  {_rate("bidirectional_packets")} AS "Flow Pkts/s", {_rate("src2dst_packets")} AS "Fwd Pkts/s", {_rate("dst2src_packets")} AS "Bwd Pkts/s",
  CASE WHEN {_fin("src2dst_packets")} > 0 THEN round(({_fin("dst2src_packets")}) / src2dst_packets, 6) ELSE 0 END AS "Down/Up Ratio",
  pow({_fin("bidirectional_stddev_ps")}, 2) AS "Pkt Len Var", {_fin("src2dst_packets")} AS "Fwd Act Data Pkts",
  {_fin("src2dst_min_ps")} AS "Fwd Seg Size Min" FROM meter""")
def p11(spark, sf_dir):
    rounded = ("Flow Byts/s", "Flow Pkts/s", "Fwd Pkts/s", "Bwd Pkts/s", "Down/Up Ratio")
    df = flow_features(meter(spark, sf_dir), KEYS)
    return df.select(*KEYS, *[
        F.round(col(f), 6).alias(f) if f in rounded else col(f) for f in FEATURES if f not in METER_COLUMNS
    ])


@query("p12_flow_meta", f"""{WITH_METER} SELECT {_K}, src_ip, coalesce(dst_ip, '') AS dst_ip, CAST(trunc(src_port) AS INT) AS src_port,
  CAST(trunc(dst_port) AS INT) AS dst_port, CAST(coalesce(protocol, 0) AS INT) AS protocol,
  CAST(trunc(bidirectional_first_seen_ms) AS BIGINT) AS start_time_ms, CAST(trunc(bidirectional_last_seen_ms) AS BIGINT) AS end_time_ms FROM meter""")
def p12(spark, sf_dir):
    return flow_meta(meter(spark, sf_dir), KEYS)


@query("p09_feature_vector", f"""{WITH_FLOWS} SELECT {_K}, {", ".join(
    f'CAST({dict([("Dst Port", "dst_port"), ("Tot Fwd Pkts", "fwd_pkts"), ("SYN Flag Cnt", "syn_pkts")]).get(f, "0")} AS DOUBLE) AS "{f}"'
    for f in FEATURES)} FROM flows_v""")
def p09(spark, sf_dir):
    maps = flows(spark, sf_dir).select(*KEYS, F.create_map(
        F.lit("Dst Port"), F.col("dst_port").cast("double"), F.lit("Tot Fwd Pkts"), F.col("fwd_pkts").cast("double"),
        F.lit("SYN Flag Cnt"), F.col("syn_pkts"), F.lit("no feature"), F.lit(9.0), F.lit("Idle Min"), F.lit(float("nan")),
    ).alias("values"))
    return feature_vector(maps, KEYS, map_column="values")


# ---- sampling, encoding, scaling
_HASH = "md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey))"
_CAPPED = f"""{WITH_FLOWS}, tagged AS (SELECT *, concat('day', CAST(l_suppkey % 4 AS VARCHAR), '.csv') AS source_file, {_HASH} AS h FROM flows_v),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file, label = 'Benign' ORDER BY h) AS rn FROM tagged),
 capped AS (SELECT * FROM ranked WHERE label <> 'Benign' OR rn <= 1000)"""


def _files(spark, sf_dir):
    return flows(spark, sf_dir).withColumn("source_file", F.concat(F.lit("day"), (F.col("l_suppkey") % 4).cast("string"), F.lit(".csv")))


@query("x01_cap_benign", f"{_CAPPED} SELECT {_K}, source_file, label FROM capped")
def x01(spark, sf_dir):
    return cap_benign(_files(spark, sf_dir), 1000, "source_file", "label", keys=KEYS).select(*KEYS, "source_file", "label")


@query("x02_label_encode", f"""{WITH_FLOWS} SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_enc, count(*) AS n FROM flows_v GROUP BY label""")
def x02(spark, sf_dir):
    df = flows(spark, sf_dir)
    return encode_labels(df, fit_labels(df, "label"), "label").groupBy("label", F.col("label_enc").cast("bigint").alias("label_enc")).agg(F.count("*").alias("n"))


_SPLIT = f"""{WITH_FLOWS}, cls AS (SELECT label, count(*) AS n FROM flows_v GROUP BY label),
 share AS (SELECT label, n, floor(n * 0.2E0) AS fl, n * 0.2E0 - floor(n * 0.2E0) AS rest, ceil(sum(n) OVER () * 0.2E0) AS total FROM cls),
 quota AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS k FROM share),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH}) AS rn FROM flows_v),
 marked AS (SELECT r.*, r.rn <= q.k AS is_test FROM ranked r JOIN quota q USING (label))"""


@query("x03_stratified_split", f"{_SPLIT} SELECT {_K}, label, is_test FROM marked")
def x03(spark, sf_dir):
    return mark_test(flows(spark, sf_dir), "label", keys=KEYS).select(*KEYS, "label", "is_test")


_SCALED = ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "syn_pkts", "fin_pkts", "duration_ms")


def _scaled_sql(where: str) -> str:
    fit = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_s" for c in (*_SCALED, "one"))
    use = ", ".join(f"round((x.{c} - f.{c}_m) / f.{c}_s, 6) + 0.0 AS {c}" for c in (*_SCALED, "one"))
    return f"""{WITH_FLOWS}, x AS (SELECT *, 1.0E0 AS one FROM flows_v), f AS (SELECT {fit} FROM x WHERE {where}) SELECT {_K}, {use} FROM x, f"""


def _scaled(spark, sf_dir, where):
    columns = [*_SCALED, "one"]
    df = flows(spark, sf_dir).withColumn("one", F.lit(1.0))
    out = scale(df, fit_scaler(df.filter(where), columns), columns)
    return out.select(*KEYS, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


@query("x04_standard_scale", _scaled_sql("l_partkey % 5 <> 0"))
def x04(spark, sf_dir):
    return _scaled(spark, sf_dir, "l_partkey % 5 <> 0")


@query("x05_benign_scale", _scaled_sql("label = 'Benign'"))
def x05(spark, sf_dir):
    return _scaled(spark, sf_dir, "label = 'Benign'")


@query("x06_random_rows", f"{WITH_FLOWS} SELECT {_K} FROM flows_v ORDER BY {_HASH} LIMIT 1000")
def x06(spark, sf_dir):
    return sample_rows(flows(spark, sf_dir), 1000, KEYS).select(*KEYS)


@query("s06_dataset_summary", f"""{_SPLIT} SELECT count(*) FILTER (NOT is_test) AS train_rows, count(*) FILTER (is_test) AS test_rows,
  count(*) FILTER (NOT is_test AND label = 'Benign') AS benign_train_rows, 72 AS n_features, count(DISTINCT label) AS n_classes,
  list_sort(list(DISTINCT label)) AS classes FROM marked""")
def s06(spark, sf_dir):
    return dataset_summary(mark_test(flows(spark, sf_dir), "label", keys=KEYS), FEATURES, "label")


@query("s05_persisted_tables", f"{_SPLIT} SELECT is_test, label, count(*) AS n FROM marked GROUP BY ALL")
def s05(spark, sf_dir):
    root = scratch_path(spark, "tables")
    marked = mark_test(flows(spark, sf_dir), "label", keys=KEYS)
    write_tables({"split": marked}, root, {"split": ["label"]})
    return read_table(spark, root, "split").groupBy("is_test", "label").agg(F.count("*").alias("n"))


@query("s07_feature_list", f"""{WITH_FLOWS} SELECT p - 1 AS position, f AS feature, (SELECT count(*) FROM flows_v) AS rows
FROM (SELECT unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS f, generate_subscripts([{", ".join("0" for _ in FEATURES)}], 1) AS p)""")
def s07(spark, sf_dir):
    root = scratch_path(spark, "lists")
    rows = flows(spark, sf_dir).agg(F.count("*").alias("rows"))
    write_json(feature_table(spark, FEATURES), root, "features")
    return spark.read.schema("position int, feature string").json(f"{root}/features").withColumn("rows", rows.scalar())


@query("s08_persisted_scaler", _scaled_sql("label = 'Benign'"))
def s08(spark, sf_dir):
    root = scratch_path(spark, "scaler")
    columns = [*_SCALED, "one"]
    df = flows(spark, sf_dir).withColumn("one", F.lit(1.0))
    write_tables({"scaler": fit_scaler(df.filter(F.col("label") == BENIGN), columns)}, root)
    out = scale(df, read_table(spark, root, "scaler"), columns)
    return out.select(*KEYS, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


