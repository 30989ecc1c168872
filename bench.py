"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from flowwarden.catalog import QUERIES
from flowwarden.session import build_session

HEADLINE = (
    "v05_verdict_summary", "v05_score_flows", "s11_batch_counts", "p17_alert_payload",
    "p06_clean_job", "p10_renamed_features", "f06_near_constant", "a04_missing_profile", "a05_describe",
    "a06_mean_ratio", "a09_correlation_wide", "a10_high_correlation",
    "a12_class_report", "a16_detection_table", "a17_threshold_sweep", "a21_histogram", "w02_w03_areas", "m09_benign_thresholds",
    "x01_cap_benign", "x03_stratified_split", "x04_standard_scale",
    "d02_dedup", "d03_suppressed", "d05_flow_assembly", "d01_stream_scoring", "d02_sent_alerts", "a19_counters",
    "d02_stream_sent_alerts", "d05_stream_assembly", "e02_live_job", "t02_top_importances",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    names = [q for q in HEADLINE if not wanted or any(q.startswith(w) for w in wanted)]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "rows": rows, "rows_per_sec": {q: int(rows / t) for q, t in times.items() if t > 0},
    }))


if __name__ == "__main__":
    main()
