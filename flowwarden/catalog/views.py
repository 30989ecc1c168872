"""Flow, raw-flow, packet and meter views derived from the driver tables.

The SQL text is shared by Spark and the DuckDB oracle; :func:`duck` rewrites the
few spellings that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune

FLOWS_V = """
SELECT
  l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_suppkey % 17 = 0 THEN concat('fe80::', CAST(l_suppkey % 20 AS STRING)) ELSE concat('10.0.0.', CAST(l_suppkey % 20 AS STRING)) END AS src_ip,
  CASE WHEN l_partkey % 53 = 0 THEN '224.0.0.251' ELSE concat('10.1.0.', CAST(l_partkey % 5 AS STRING)) END AS dst_ip,
  CAST(1024 + l_orderkey % 50000 AS INT) AS src_port,
  CASE WHEN l_returnflag = 'N' THEN 0
       ELSE CASE l_partkey % 10 WHEN 0 THEN 21 WHEN 1 THEN 22 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 8080
                 WHEN 5 THEN 53 WHEN 6 THEN 67 WHEN 7 THEN 3389 WHEN 8 THEN 12345 ELSE 8443 END END AS dst_port,
  CASE l_returnflag WHEN 'A' THEN 6 WHEN 'R' THEN 17 ELSE 1 END AS protocol,
  l_orderkey * 250 + l_partkey * 17 AS start_time_ms,
  (l_orderkey % 41) * 500 AS duration_ms,
  CAST(l_quantity AS BIGINT) AS fwd_pkts,
  CAST(l_linenumber - 1 AS BIGINT) AS bwd_pkts,
  CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice) AS DOUBLE) ELSE CAST(l_partkey % 100 AS DOUBLE) END AS fwd_bytes,
  CASE WHEN l_linenumber = 1 THEN 0.0E0 ELSE CAST(l_suppkey % 150 AS DOUBLE) END AS bwd_bytes,
  CAST(floor(round(l_discount * 100) * l_quantity / 5) AS DOUBLE) AS syn_pkts,
  CAST(l_suppkey % 3 AS DOUBLE) AS fin_pkts,
  CAST(floor(round(l_tax * 100) * l_quantity / 8) AS DOUBLE) AS psh_pkts,
  CASE WHEN l_partkey % 4 = 0 THEN CAST(floor(l_quantity / 10) AS DOUBLE) ELSE 0.0E0 END AS urg_pkts,
  (l_partkey % 101) / 100.0E0 AS rf_confidence,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Benign' WHEN l_suppkey % 3 = 0 THEN 'Bot' ELSE 'SSH-Bruteforce' END AS rf_label,
  l_extendedprice / 20000 AS ae_score,
  CASE WHEN l_discount > 0.08 THEN 'Bot' WHEN l_tax > 0.07 THEN 'SSH-Bruteforce' WHEN l_quantity > 48 THEN 'Infilteration' ELSE 'Benign' END AS label
FROM lineitem
"""

RAW_FLOWS_V = """
SELECT
  concat('day', CAST(l_suppkey % 4 AS STRING), '.csv') AS source_file,
  CASE WHEN l_partkey % 61 = 0 THEN 'Dst Port' ELSE CAST(dst_port AS STRING) END AS `Dst Port`,
  CAST(fwd_pkts AS STRING) AS `Tot Fwd Pkts`,
  concat(' ', CAST(CAST(fwd_bytes AS BIGINT) AS STRING), ' ') AS `TotLen Fwd Pkts`,
  CASE WHEN duration_ms = 0 THEN 'NaN' WHEN l_partkey % 97 = 0 THEN 'Infinity' WHEN l_partkey % 89 = 0 THEN NULL
       ELSE CAST(CAST(fwd_bytes AS BIGINT) AS STRING) END AS `Flow Byts/s`,
  CASE WHEN l_partkey % 83 = 0 THEN 'abc' ELSE CAST(CAST(syn_pkts AS BIGINT) AS STRING) END AS `SYN Flag Cnt`,
  '0' AS `Fwd Byts/b Avg`,
  '20/02/2018 08:33:07' AS `Timestamp`,
  CASE WHEN l_partkey % 61 = 0 THEN 'Label' WHEN l_suppkey % 2 = 0 THEN concat(' ', label, ' ') ELSE label END AS `Label`
FROM flows_v
"""

PACKETS_V = """
SELECT event_id, ts, user_id AS src_key,
  CAST(get_json_object(props, '$.k') AS INT) % 4 AS dst_key,
  CASE WHEN event_id % 3 = 0 THEN 'bwd' ELSE 'fwd' END AS direction,
  value AS pkt_size,
  CASE event_type WHEN 'signup' THEN 'SYN' WHEN 'purchase' THEN 'PSH' WHEN 'error' THEN 'RST' WHEN 'click' THEN 'ACK' ELSE 'FIN' END AS tcp_flag
FROM events
"""

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

# flow view column -> feature column
FEATURE_OF = {
    "fwd_pkts": "Tot Fwd Pkts",
    "bwd_pkts": "Tot Bwd Pkts",
    "fwd_bytes": "TotLen Fwd Pkts",
    "bwd_bytes": "TotLen Bwd Pkts",
    "syn_pkts": "SYN Flag Cnt",
    "fin_pkts": "FIN Flag Cnt",
    "psh_pkts": "PSH Flag Cnt",
    "urg_pkts": "URG Flag Cnt",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLOWS_V.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def feature_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows under the feature names the operators read."""
    return as_features(flows(spark, sf_dir))


def as_features(df: DataFrame) -> DataFrame:
    return (
        df.withColumns({
            "Flow Duration": F.col("duration_ms") * F.lit(1000.0),
            "end_time_ms": F.col("start_time_ms") + F.col("duration_ms"),
        })
        .withColumnsRenamed(FEATURE_OF)
    )


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_FLOWS_V.replace("FROM flows_v", "FROM {flows_v}"), flows_v=flows(spark, sf_dir))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        PACKETS_V.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def duck(sql: str) -> str:
    return sql.replace("`", '"').replace("get_json_object", "json_extract_string")


WITH_FLOWS = f"WITH RECURSIVE flows_v AS ({duck(FLOWS_V)})"
WITH_RAW = f"{WITH_FLOWS}, raw_flows_v AS ({duck(RAW_FLOWS_V)})"
WITH_PACKETS = f"WITH RECURSIVE packets_v AS ({duck(PACKETS_V)})"
