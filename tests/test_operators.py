"""Brute-force comparisons and invariants on small fixtures."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from flowwarden.functions import joins
from flowwarden.functions.prefix import exact_percentiles, running_totals
from flowwarden.operators.autoencoder import Autoencoder, feature_weights, layer_sizes
from flowwarden.operators.cleaning import clean, force_numeric
from flowwarden.operators.assembly import assemble_flows
from flowwarden.operators.dedup import dedup_timeline, sent_alerts
from flowwarden.operators.features import flow_features
from flowwarden.operators.oversample import nearest_neighbours
from flowwarden.operators.profile import constant_columns
from flowwarden.operators.sampling import cap_benign, mark_test, sample_rows
from flowwarden.operators.scaling import fit_scaler, scale
from flowwarden.sources.day_files import read_day_files
from flowwarden.sources.streams import read_flow_stream, write_alerts, write_batches, write_stream
from flowwarden.streaming.assembly import assemble_stream
from flowwarden.streaming.counters import CounterLog, counter_totals as observed_totals, observed
from flowwarden.streaming.dedup import dedup_stream, sent_alert_stream


def greedy(times, window):
    last, sent, held, out = None, [], 0, []
    for t in sorted(times):
        if last is None or t - last >= window:
            out.append((t, held))
            last, held = t, 0
        else:
            held += 1
    return out + ([(None, held)] if held else [])


@pytest.mark.parametrize("span,n", [(3_000_000, 400), (200_000, 3000), (40_000_000, 200)])
def test_dedup_against_sequential_fold(spark, span, n):
    rng = random.Random(span)
    rows = [("hot" if i % 3 else f"k{i % 7}", "x", "ATTACK", rng.randrange(span)) for i in range(n)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, verdict string, end_time_ms long")
    got = {}
    for r in dedup_timeline(df).collect():
        got.setdefault(r["src_ip"], []).append((r["sent_ms"], r["suppressed"]))
    for key in {r[0] for r in rows}:
        want = greedy([r[3] for r in rows if r[0] == key], 30_000)
        assert sorted(got[key], key=lambda x: (x[0] is None, x[0] or 0)) == want
    assert sum(1 + h if t is not None else h for v in got.values() for t, h in v) == n


def test_dedup_disabled(spark):
    df = spark.createDataFrame([("a", "b", "ATTACK", 1), ("a", "b", "ATTACK", 2)], "src_ip string, dst_ip string, verdict string, end_time_ms long")
    assert dedup_timeline(df, window_s=0).count() == 2


def _streamed(spark, tmp_path, parts, schema, job):
    """The rows a stream wrote whose input arrived in ``parts``, one micro-batch each."""
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        df = job(read_flow_stream(spark, source, spark.read.parquet(source).schema))
        write_stream(df, out, state).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@pytest.mark.parametrize("flush_s", [0.0, 45.0])
def test_stream_dedup_over_batches_equals_table(spark, tmp_path, flush_s):
    rng = random.Random(5)
    times = sorted(t + 200_000 * (t > 500_000) + 300_000 * (t > 1_200_000) for t in (rng.randrange(2_000_000) for _ in range(300)))
    rows = [("a" if i % 2 else None, "x", "ATTACK", t, i) for i, t in enumerate(times)]
    rows += [(*r[:4], r[4] + 1000) for r in rows[::7]]
    schema = "src_ip string, dst_ip string, verdict string, end_time_ms long, n int"
    batches = [sorted((r for r in rows if times[100 * k] <= r[3] < (times + [10**9])[100 * k + 100]), key=lambda _: rng.random()) for k in range(3)]
    for k in range(2):  # late by less than the delay
        late = [r for r in batches[k] if times[100 * k + 99] - r[3] < 20_000][:3]
        batches[k] = [r for r in batches[k] if r not in late]
        batches[k + 1] += late
    end = [[("z", "z", "ATTACK", 10**8, 0)], [("z", "z", "ATTACK", 2 * 10**8, 0)]]
    df = spark.createDataFrame(rows, schema)
    (tmp_path / "t").mkdir()
    got = _streamed(spark, tmp_path / "t", batches + end, schema, lambda s: dedup_stream(s, flush_s=flush_s)).filter("src_ip IS NULL OR src_ip <> 'z'")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, dedup_timeline(df, flush_s=flush_s).collect()))
    assert got.filter("sent_ms IS NULL").count() >= 2 and (flush_s == 0 or not got.filter("sent_ms IS NOT NULL AND suppressed > 0").isEmpty())
    (tmp_path / "r").mkdir()
    sent = _streamed(spark, tmp_path / "r", batches + end, schema, lambda s: sent_alert_stream(s, ["n"], flush_s=flush_s)).filter("src_ip IS NULL OR src_ip <> 'z'")
    assert Counter(map(tuple, sent.collect())) == Counter(map(tuple, sent_alerts(df, ["n"], flush_s=flush_s).collect()))


def test_stream_assembly_over_batches_equals_table(spark, tmp_path):
    """Idle gaps, the active cap and packets of one millisecond, over batches that cut flows, with late packets."""
    rng = random.Random(9)
    t, times = 0, []
    for _ in range(500):
        t += rng.choice([0, 0, 1, 40, 900, 900, 3_000, 11_000])
        times.append(t)
    way, flag = ["fwd", "fwd", "bwd", "odd"], ["SYN", "PSH", "URG", "ACK", None]
    rows = [("a" if i % 3 else None, i % 2, t, rng.choice(way), float(rng.randrange(40, 1500)), rng.choice(flag)) for i, t in enumerate(times)]
    batches = [rows[k : k + 100] for k in range(0, 500, 100)]
    for k in range(4):
        late = [r for r in batches[k][-8:-2] if batches[k][-1][2] - r[2] < 5_000]
        batches[k] = [r for r in batches[k] if r not in late]
        batches[k + 1] = late + batches[k + 1]
    end = [[("z", 0, 10**8, "fwd", 1.0, None)], [("z", 0, 2 * 10**8, "fwd", 1.0, None)], [("z", 0, 3 * 10**8, "fwd", 1.0, None)]]
    schema = "src_key string, dst_key int, ms long, direction string, pkt_size double, tcp_flag string"
    timed = lambda df: df.withColumn("ts", F.timestamp_millis("ms"))
    got = _streamed(spark, tmp_path, batches + end, schema, lambda s: assemble_stream(timed(s), idle_ms=10_000, active_ms=15_000))
    got = got.filter("src_key IS NULL OR src_key <> 'z'")
    want = assemble_flows(timed(spark.createDataFrame(rows, schema)), idle_ms=10_000, active_ms=15_000, slice_ms=2_000)
    assert got.columns == want.columns
    order = lambda r: (r["src_key"] or "", r["dst_key"], r["bidirectional_first_seen_ms"])
    found, wanted = sorted(got.collect(), key=order), sorted(want.collect(), key=order)
    assert len(found) == len(wanted) > 30 and any(r.bidirectional_duration_ms >= 10_000 for r in wanted)
    for f, w in zip(found, wanted):
        for c in got.columns:
            assert f[c] == w[c] or f[c] == pytest.approx(w[c], rel=1e-9, abs=1e-6), (c, f, w)


def test_alert_sink_rerun_leaves_same_rows(spark, tmp_path):
    from flowwarden.catalog.streams import flow_stream
    from flowwarden.catalog.views import as_features
    from flowwarden.streaming.jobs import score_stream

    out = str(tmp_path / "alerts")
    for run in ("one", "two"):  # a lost checkpoint repeats batch 0
        write_alerts(score_stream(as_features(flow_stream(spark, SF))), out, str(tmp_path / run)).awaitTermination()
        counts = spark.read.parquet(out).count()
        assert spark.read.parquet(out).filter("verdict = 'BENIGN'").isEmpty()
        assert run == "one" or counts == first
        first = counts


def test_alert_sink_keeps_the_runs_of_other_names(spark, tmp_path):
    schema = "id int"
    out = str(tmp_path / "out")
    for run, ids in (("one", [1, 2]), ("two", [3]), ("one", [1, 2])):
        source = str(tmp_path / f"in-{run}")
        spark.createDataFrame([(i,) for i in ids], schema).coalesce(1).write.mode("overwrite").parquet(source)
        stream = read_flow_stream(spark, source, spark.read.parquet(source).schema)
        write_batches(stream, out, str(tmp_path / f"state-{run}-{len(list(tmp_path.iterdir()))}"), run).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "run").collect())) == [(1, "one"), (2, "one"), (3, "two")]
    with pytest.raises(ValueError):
        write_batches(stream, out, str(tmp_path / "x"), "a/b")


def test_observed_counters_over_many_batches(spark, tmp_path):
    """More batches than the session keeps progress reports of; flows without model outputs are errors."""
    from flowwarden.catalog.views import as_features, flows
    from flowwarden.plans.reports import error_count, flow_counters
    from flowwarden.plans.scoring import score_flows

    gone = F.when(F.col("l_partkey") % 7 != 0, F.col("ae_score"))
    part = as_features(flows(spark, SF)).limit(240).withColumn("ae_score", gone).repartition(120).cache()
    source = str(tmp_path / "in")
    part.write.parquet(source)
    log_path = str(tmp_path / "log")
    with CounterLog(spark, log_path) as log:
        stream = read_flow_stream(spark, source, part.schema, files_per_batch=1)
        log.wait(write_stream(observed(score_flows(stream)).select("verdict"), str(tmp_path / "out"), str(tmp_path / "state")))
    rows = spark.read.parquet(log_path)
    assert rows.select("batch_id").distinct().count() > 100
    got = observed_totals(rows.unionByName(rows)).first().asDict()
    want = score_flows(part).agg(*flow_counters(), error_count()).first().asDict()
    assert got.pop("flows_per_second") > 0 and got == want and got["errors"] > 0


def test_percentiles_and_running_totals(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), np.full(250, 1.5)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    names = {"a": 0.0, "b": 0.333, "c": 0.5, "d": 0.999, "e": 1.0}
    row = exact_percentiles(df, "x", names).first()
    for n, p in names.items():
        assert row[n] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)
    one = spark.createDataFrame([(i, i % 5) for i in range(100)], "k int, n int")
    got = {r["k"]: r["cum_n"] for r in running_totals(one, "k", ["n"], partitions=7).collect()}
    assert [got[i] for i in range(100)] == np.cumsum([i % 5 for i in range(100)]).tolist()


@pytest.mark.parametrize("bracket, rows", [(1e-4, 10**6), (0.02, 10**6), (0.02, 5)])
def test_percentiles_by_selection(spark, monkeypatch, bracket, rows):
    """Brackets that leave most values out, ties over a bracket's edge, groups of one, NULL groups, and missed brackets."""
    from flowwarden.functions import prefix

    monkeypatch.setattr(prefix, "WINDOW_ROWS", rows)
    rng = np.random.default_rng(7)
    groups = {"n": rng.normal(size=3000), "t": rng.integers(0, 4, 2000).astype(float), "one": np.array([3.5]), None: rng.exponential(size=1500), "two": np.array([-1.0, 8.0])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("n", None), ("n", float("nan")), ("gone", None)]
    df = spark.createDataFrame(data, "a string, x double").repartition(5)
    names = {f"p{i}": p for i, p in enumerate((0.0, 0.001, 0.333, 0.5, 0.999, 1.0))}

    def check():
        got = {r["a"]: r for r in exact_percentiles(df, "x", names, ["a"], bracket).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert [got[g][n] for n in names] == pytest.approx([np.percentile(xs, 100 * p) for p in names.values()], abs=1e-12)

    check()
    every = np.concatenate(list(groups.values()))
    assert exact_percentiles(df, "x", {"p": 0.77}, (), bracket).first()["p"] == pytest.approx(np.percentile(every, 77), abs=1e-12)
    assert exact_percentiles(df.limit(0), "x", {"p": 0.5}).first()["p"] is None
    wide = spark.createDataFrame([(float(x), float(y), None, float(z)) for x, y, z in zip(groups["n"], rng.integers(0, 3, 3000), rng.exponential(size=3000))],
                                 "`a b` double, t double, gone double, e double").union(spark.createDataFrame([(None, float("nan"), None, None)], "a double, b double, c double, d double"))

    def check_wide():
        got = {r["column_name"]: r for r in prefix.column_percentiles(wide, wide.columns, names, bracket=bracket).collect()}
        assert set(got) == {"a b", "t", "e"}
        for c, r in got.items():
            xs = np.array([x[c] for x in wide.collect() if x[c] is not None and x[c] == x[c]])
            assert [r[n] for n in names] == pytest.approx([np.percentile(xs, 100 * p) for p in names.values()], abs=1e-12)

    check_wide()
    assert prefix.column_percentiles(wide.limit(0), wide.columns, names).count() == 0
    if bracket == 0.02 and rows > 5:  # a sketch that names the wrong places
        real = prefix.F.percentile_approx
        monkeypatch.setattr(prefix.F, "percentile_approx", lambda c, p, a: real(c, [x / 2 for x in p], a))
        check()
        check_wide()


def test_sampling_is_exact_with_copies(spark):
    rows = [("f1", "Benign", 7)] * 60 + [("f1", "Benign", i) for i in range(40)] + [("f1", "Bot", i) for i in range(30)] + [("f2", "Benign", 1)] * 5
    df = spark.createDataFrame(rows, "source_file string, Label string, x int")
    out = cap_benign(df, cap=50)
    counts = {(r[0], r[1]): r[2] for r in out.groupBy("source_file", "Label").count().collect()}
    assert counts == {("f1", "Benign"): 50, ("f1", "Bot"): 30, ("f2", "Benign"): 5}
    marked = mark_test(df)
    assert marked.count() == len(rows)
    assert marked.filter("is_test").count() == 27
    assert sample_rows(df, 17).count() == 17
    assert sample_rows(df, 1000).count() == len(rows)


def test_large_lookup_takes_the_salted_join(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, v int")
    look = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, w int")
    key = lambda r: (r["k"] or "", r["v"], r["w"])
    small = sorted(key(r) for r in joins.join_lookup(big, look, ["k"], max_rows=10).collect())
    salted = sorted(key(r) for r in joins.join_lookup(big, look, ["k"], max_rows=1).collect())
    assert small == salted and len(small) == 52


def test_cleaning(spark):
    df = spark.createDataFrame(
        [("1", " 2 ", "Benign"), ("abc", "Infinity", "Bot"), (None, "NaN", "Bot"), ("1d", "-inf", "Bot"), ("1e3", ".5", "Bot")],
        "a string, `Flow Byts/s` string, Label string",
    )
    assert [tuple(r) for r in clean(df).select("a", "`Flow Byts/s`").collect()] == [(1, 2), (0, 0), (0, 0), (0, 0), (1000, 0.5)]
    assert force_numeric(df, ["a"]).filter("a IS NULL").count() == 3
    numbers = spark.createDataFrame([(1.0, 2.0, float("nan")), (1.0, 3.0, float("nan"))], "c double, d double, e double")
    assert constant_columns(numbers, ["c", "d", "e"]) == ["c", "e"]


def test_day_files_with_different_headers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Flow ID, Dst Port ,Label\nid,80, Bot \n")
    (tmp_path / "a.csv").write_text("Label, Dst Port \nBenign,22\nLabel,Dst Port\n")
    rows = {(r["source_file"], r["Dst Port"], r["Flow ID"]) for r in read_day_files(spark, str(tmp_path)).collect()}
    assert rows == {("a.csv", "22", None), ("a.csv", "Dst Port", None), ("b.csv", "80", "id")}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        read_day_files(spark, str(tmp_path / "none"))


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = scale(df, fit_scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in out) == [(-1.0, 0.0), (1.0, 0.0)]


def test_features_of_empty_and_extreme_flows(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), 0.0, 5.0), (2, 10.0, 2000.0, None), (3, float("inf"), -1.0, 4.0)],
        "id int, src2dst_packets double, bidirectional_duration_ms double, dst2src_packets double",
    )
    rows = {r["id"]: r for r in flow_features(df, ["id"]).collect()}
    assert len(rows[1]) == 73
    assert (rows[2]["Fwd Pkts/s"], rows[2]["Flow Duration"], rows[2]["Bwd Pkts/s"]) == (5.0, 2_000_000.0, 0.0)
    assert rows[1]["Tot Fwd Pkts"] == rows[3]["Tot Fwd Pkts"] == rows[3]["Flow Pkts/s"] == 0.0


def test_neighbours_against_brute_force_over_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(90, 3)).astype(float)
    ids = [f"{i:03d}" for i in range(90)]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "_id string, _x array<double>")
    got = {}
    for r in nearest_neighbours(points, 4, block_rows=20).collect():
        got.setdefault(r["_id"], {})[r["rank"]] = r["_other"]
    for a, i in enumerate(ids):
        order = sorted((float(((x[a] - x[b]) ** 2).sum()), j) for b, j in enumerate(ids) if b != a)
        assert [got[i][r] for r in range(1, 5)] == [j for _, j in order[:4]]


@pytest.mark.parametrize("block_rows", [7, 64, 2048])
def test_neighbours_of_copies_and_clusters(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    x = np.concatenate([rng.normal(size=(150, 3)), 50 + rng.normal(size=(60, 3)), np.repeat([[1.0, 2.0, 3.0]], 90, axis=0), rng.integers(0, 3, (60, 3)), [[1e6, 0, 0]]])
    ids = [f"{i:04d}" for i in rng.permutation(len(x))]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [("bad", [float("nan"), 0.0, 0.0]), ("far", [float("inf"), 0.0, 0.0])]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "_id string, _x array<double>"), 4, block_rows).collect():
        got.setdefault(r["_id"], {})[r["rank"]] = r["_other"]
        assert tuple(r["_nx"]) == tuple(x[ids.index(r["_other"])])
    assert set(got) == set(ids)
    for a, i in enumerate(ids):
        distance = np.zeros(len(x))
        for j in range(3):
            distance += (x[a, j] - x[:, j]) ** 2
        order = sorted((d, o) for d, o in zip(distance.tolist(), ids) if o != i)
        assert [got[i][r] for r in range(1, 5)] == [o for _, o in order[:4]]


def test_neighbours_of_none_and_one(spark):
    empty = spark.createDataFrame([], "_id string, _x array<double>")
    assert nearest_neighbours(empty, 3).count() == 0
    one = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "_id string, _x array<double>")
    assert sorted((r["_id"], r["_other"], r["rank"]) for r in nearest_neighbours(one, 3).collect()) == [("a", "b", 1), ("b", "a", 1)]


def test_autoencoder_gradient_matches_differences():
    rng = np.random.default_rng(0)
    model = Autoencoder.initial(layer_sizes(5, (4, 3)), rng.uniform(0.5, 2, 5))
    x = rng.normal(size=(7, 5))
    _, grad = model.gradient(x)
    for i in range(0, len(model.params), 5):
        step = np.zeros_like(model.params)
        step[i] = 1e-6
        up = Autoencoder(model.sizes, model.params + step, model.weights).gradient(x)[0]
        down = Autoencoder(model.sizes, model.params - step, model.weights).gradient(x)[0]
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    assert model.errors(x).mean() == pytest.approx(model.gradient(x)[0])


def test_feature_weights_mean_one(spark):
    table = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", 1.0)], "feature string, importance double")
    got = {r["feature"]: r["weight"] for r in feature_weights(table).collect()}
    assert sum(got.values()) / 3 == pytest.approx(1.0) and got["c"] / got["a"] == pytest.approx(10.0, rel=1e-6)




def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_reads_its_chain_once_with_forward_windows(spark):
    df = spark.createDataFrame([("a", "b", "ATTACK", t) for t in range(0, 500_000, 7_000)], "src_ip string, dst_ip string, verdict string, end_time_ms long")
    plan = _plan(dedup_timeline(df))
    assert "unboundedfollowing" not in plan and plan.count("MapInPandas") == 3


def test_chain_steps_share_the_merged_events(spark):
    df = spark.createDataFrame([("a", "b", "ATTACK", t) for t in range(0, 500_000, 7_000)], "src_ip string, dst_ip string, verdict string, end_time_ms long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "ReusedExchange" in _plan(dedup_timeline(df))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
