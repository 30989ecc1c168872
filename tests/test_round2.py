"""Dirty input, NULL keys, any number of classes and columns, counters over many batches."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowwarden.functions.batches import group_starts, whole_groups
from flowwarden.operators.assembly import assemble_flows
from flowwarden.operators.dedup import sent_alerts
from flowwarden.operators.encoding import fit_labels
from flowwarden.operators.features import flow_meta
from flowwarden.operators.oversample import oversample
from flowwarden.operators.profile import correlations
from flowwarden.plans.offline import Detector, prepare, train
from flowwarden.plans.scoring import score_flows
from flowwarden.streaming.jobs import counter_totals, write_counters


def test_huge_numbers_do_not_fail(spark):
    row = spark.createDataFrame([("a", "b", 1e30, 6.0, 1e300, "Benign", 0.9, 0.1)],
                                "src_ip string, dst_ip string, `Dst Port` double, Protocol double, `Tot Fwd Pkts` double, rf_label string, rf_confidence double, ae_score double")
    out = score_flows(row).first()
    assert out["verdict"] in ("BENIGN", "SUSPECT", "ATTACK", "ANOMALY")
    meta = flow_meta(spark.createDataFrame([(1e30, None)], "dst_port double, src_port double")).first()
    assert (meta["dst_port"], meta["src_port"]) == (0, 0)


def test_alerts_and_packets_with_null_keys_are_kept(spark):
    alerts = spark.createDataFrame([(None, "b", "ATTACK", 0, 1), (None, "b", "ATTACK", 1_000, 2), (None, None, "ATTACK", 5, 3), ("a", "b", "ATTACK", 7, 4)],
                                   "src_ip string, dst_ip string, verdict string, end_time_ms long, n int")
    assert sorted(r.n for r in sent_alerts(alerts, ["n"]).collect()) == [1, 3, 4]
    packets = spark.createDataFrame([(None, 1, 0, "fwd", 10.0, "SYN"), (None, 1, 5, "bwd", 20.0, "ACK"), (2, None, 0, "fwd", 5.0, "FIN")],
                                    "src_key long, dst_key int, ms long, direction string, pkt_size double, tcp_flag string")
    flows = assemble_flows(packets.withColumn("ts", F.timestamp_millis("ms")).drop("ms"))
    assert sorted((r.src_key or -1, r.dst_key or -1, r.bidirectional_packets) for r in flows.collect()) == [(-1, 1, 2), (2, -1, 1)]


def test_labels_of_any_number(spark):
    labels = spark.range(5_000).select(F.format_string("c%05d", F.col("id")).alias("label")).unionByName(spark.createDataFrame([(None,)], "label string"))
    got = fit_labels(labels, "label").collect()
    assert sorted((r.label, r.label_enc) for r in got) == [(f"c{i:05d}", i) for i in range(5_000)]


@pytest.mark.parametrize("width", [3, 6, 7, 72])
def test_correlations_with_nulls_equal_sql(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(1e6, 1, (200, width))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.5, 200)
    data = pd.DataFrame(x, columns=[f"k {i}" for i in range(width)])
    data = data.mask(rng.random(data.shape) < 0.1)
    data.iloc[:, -1] = 4.5
    rows = [tuple(None if v != v else float(v) for v in r) for r in data.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"`k {i}` double" for i in range(width)))
    got = {(r.i, r.j): r.r for r in correlations(df, data.columns).collect()}
    assert len(got) == width * (width + 1) // 2
    con = duckdb.connect()
    con.register("t", data)
    for (i, j), r in got.items():
        if width - 1 in (i, j):
            assert r is None
        elif i < 3:
            want = con.execute(f'''SELECT corr("k {i}", "k {j}") FROM t WHERE NOT isnan("k {i}") AND NOT isnan("k {j}")''').fetchall()[0][0]
            assert r == pytest.approx(want, abs=1e-6)


def test_oversampling_beyond_the_target_is_an_error(spark):
    rows = spark.createDataFrame([(float(i), "m") for i in range(6)], "x double, label string")
    with pytest.raises(ValueError):
        oversample(rows, ["x"], "m", 5)
    assert oversample(rows, ["x"], "m", 9).count() == 3


def test_groups_over_many_batches():
    rows = pd.DataFrame({"k": [1] * 10 + [2] * 25 + [None] * 5 + [3], "v": range(41)})
    out = list(whole_groups([rows.iloc[i : i + 4] for i in range(0, 41, 4)], ["k"]))
    assert pd.concat(out)["v"].tolist() == list(range(41))
    seen = [k for part in out for k in part["k"].iloc[group_starts(part, ["k"])[:-1]].fillna(-1)]
    assert seen == [1, 2, -1, 3]


def test_counters_over_more_than_100_batches(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(0, 520, 1, 130).select(F.lit("BENIGN").alias("verdict"), F.lit(False).alias("rule_fired"), F.lit("RF+AE").alias("source")).write.parquet(str(source))
    stream = spark.readStream.schema("verdict string, rule_fired boolean, source string").option("maxFilesPerTrigger", 1).parquet(str(source))
    write_counters(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() > 100
    assert counter_totals(written).first()["flows"] == 520


@pytest.fixture(scope="module")
def detector(spark) -> Detector:
    rng = np.random.default_rng(1)
    names = ["Dst Port", "Protocol", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "SYN Flag Cnt"]
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        rows.append(("day.csv", *[str(v) for v in (22 if bad else 443, 6, *rng.integers(1, 50, 4), int(bad) * 9)], "Bot" if bad else "Benign", str(i)))
    raw = spark.createDataFrame(rows, "source_file string, " + ", ".join(f"`{n}` string" for n in names) + ", Label string, id string")
    return train(prepare(raw, keys=["id"]), oversampled=None, keys=["id"], forest_params={"trees": 3, "max_depth": 3}, autoencoder_params={"epochs": 1})


def test_models_take_dirty_rows(spark, detector):
    nan = float("nan")
    rows = [("zero", 0.0, 0.0, 0.0, "a", "b", 1.0), ("nan", nan, float("inf"), None, "a", "b", 2.0), ("port", 1e30, 6.0, 5.0, "a", "b", nan),
            ("white", 22.0, 6.0, nan, "fe80::1", "b", 3.0)]
    df = spark.createDataFrame(rows, "name string, `Dst Port` double, Protocol double, `Flow Duration` double, src_ip string, dst_ip string, extra double")
    out = {r["name"]: r for r in detector.score(df).collect()}
    assert set(out) == {"zero", "nan", "port", "white"}
    assert out["white"]["source"] == "WHITELIST" and out["white"]["class_probabilities"] == {}
    assert out["white"]["confidence"] == 1.0 and out["white"]["anomaly_score"] == 0.0
    for name in ("zero", "nan", "port"):
        assert sum(out[name]["class_probabilities"].values()) == pytest.approx(1) and np.isfinite(out[name]["anomaly_score"])
    assert out["nan"]["class_probabilities"] == out["zero"]["class_probabilities"]
