"""Findings of round 3: work per key and row that must not grow beyond the input."""

import numpy as np
import pandas as pd
import pyarrow as pa
from flowwarden.functions.verdicts import alert_label, rule_suffix
from flowwarden.operators import autoencoder, oversample
from flowwarden.operators.assembly import assemble_flows
from flowwarden.operators.rules import Rule, fired_flags
from flowwarden.sources.streams import write_stream
from flowwarden.sources.tables import write_tables
from flowwarden.streaming import assembly as stream_assembly
from pyspark.sql import functions as F


class _Value:
    """A state value of one key, as the streaming engine keeps it; counts what is asked of it."""

    def __init__(self):
        self.kept, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.kept

    def exists(self):
        self.calls.append("exists")
        return self.kept is not None

    def update(self, value):
        self.calls.append("update")
        self.kept = value

    def clear(self):
        self.calls.append("clear")
        self.kept = None


class _Handle:
    def __init__(self):
        self.value, self.timers = _Value(), []

    def getValueState(self, name, schema, *_):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(list(self.timers))


class _Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def _packets(rows):
    """(time, forward packets, backward packets, size) as merged sums of one key."""
    sums = []
    for _, fwd, bwd, size in rows:
        one = {"src2dst_n": fwd, "dst2src_n": bwd}
        for s, n in (("src2dst", fwd), ("dst2src", bwd)):
            one |= {f"{s}_sum": n * size, f"{s}_sq": n * size * size, **({f"{s}_min": size, f"{s}_max": size} if n else {f"{s}_min": np.nan, f"{s}_max": np.nan})}
        sums.append(np.array([one.get(f, 0.0) for f in stream_assembly._SENT], dtype=float))
    return pd.DataFrame({"packet_ms": [r[0] for r in rows], "sums": sums})


def _assemble(batches, idle=100, active=250):
    """Flows of (watermark, rows) batches of one key, and the handle."""
    step, handle, found = stream_assembly._Assembler(["k"], idle, active), _Handle(), []
    step.init(handle)
    for watermark, rows in batches:
        if rows:
            found += list(step.handleInputRows((1,), iter([_packets(rows)]), _Times(watermark)))
        for at in [x for x in handle.timers if x <= watermark]:
            found += list(step.handleExpiredTimer((1,), _Times(watermark), None))
            handle.deleteTimer(at)
    return np.array([x for f in found for x in f["sums"]]), handle


_ROWS = [(0, 1, 0, 5.0), (40, 2, 1, 7.0), (90, 0, 1, 3.0), (180, 1, 0, 9.0), (250, 1, 1, 2.0), (300, 0, 2, 4.0), (400, 1, 0, 1.0), (900, 0, 1, 8.0), (2000, 3, 0, 6.0)]


def test_flows_behind_the_watermark_need_no_state():
    flows, handle = _assemble([(5000, _ROWS)])
    assert handle.value.calls == ["get"] and not handle.timers  # one look at the state, whatever the number of flows
    at = stream_assembly._AT
    assert flows[:, at["first"]].tolist() == [0, 250, 400, 900, 2000] and flows[:, at["last"]].tolist() == [180, 300, 400, 900, 2000]
    assert flows[:, at["src2dst_n"]].tolist() == [4, 1, 1, 0, 3] and flows[:, at["bidirectional_gaps"]].tolist() == [5, 3, 0, 0, 2]
    assert flows[:, at["bidirectional_gap_sum"]].tolist() == [180, 50, 0, 0, 0] and flows[0, at["dst2src_gap_sum"]] == 50


def test_flows_do_not_depend_on_how_batches_cut_them():
    whole, _ = _assemble([(5000, _ROWS)])
    for cut in range(1, len(_ROWS)):
        parts, handle = _assemble([(_ROWS[cut - 1][0], _ROWS[:cut]), (5000, _ROWS[cut:])])
        np.testing.assert_array_equal(parts, whole)
        assert handle.value.kept is None and not handle.timers
    each, _ = _assemble([*[(r[0], [r]) for r in _ROWS], (5000, [])])
    np.testing.assert_array_equal(each, whole)


def test_epochs_read_matrices_that_are_packed_once(spark):
    model = autoencoder.Autoencoder.initial(autoencoder.layer_sizes(3), np.ones(3))
    rng = np.random.default_rng(0)
    x, held = rng.normal(size=(50, 3)), np.arange(50) % 5 == 0
    rows = pa.RecordBatch.from_pydict({"_x": pa.array(list(x)), "_held": pa.array(held), "_shard": pa.array([4] * 50, pa.int32())})
    packed = list(autoencoder._packed([rows.slice(0, 0), rows.slice(0, 30), rows.slice(30)]))
    assert [b.num_rows for b in packed] == [1, 1]  # a row per batch, not a row per flow
    adam = autoencoder.AdamState(np.zeros_like(model.params), np.zeros_like(model.params))
    (found,) = autoencoder._local_epoch(model, adam, 1, 16, 1e-3, 0.0, True)(packed)
    told = found.to_pylist()[0]
    assert (told["shard"], told["n"], told["n_val"], told["steps"]) == (4, 40, 10, 2 + 1)
    assert abs(told["val_loss"] - model.errors(x[held]).sum()) < 1e-9
    again, _ = autoencoder.train_autoencoder(
        spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double, c double"), ["a", "b", "c"], epochs=1, shards=2)
    assert again.params.shape == model.params.shape


def test_nearest_keeps_the_order_of_a_stable_sort():
    rng = np.random.default_rng(3)
    for width, values in ((40, 4), (40, 10_000), (3, 4)):
        distance = rng.integers(0, values, (30, width)).astype(float)
        distance[:4, ::2], distance[5] = np.inf, np.inf
        reach = np.where(np.arange(30) % 3 == 0, np.inf, values / 2)
        rows, columns = oversample._nearest(distance, reach, 5)
        near = np.argsort(distance, axis=1, kind="stable")[:, :5]
        wanted = [(r, c) for r in range(30) for c in near[r] if np.isfinite(distance[r, c]) and distance[r, c] <= reach[r]]
        assert list(zip(rows, columns)) == wanted


def test_flag_texts_are_compiled(spark):
    rows = spark.createDataFrame([(1, 5), (2, 0), (3, 9)], "id int, n int")
    made = [Rule(name, "SUSPECT", F.col("n") > limit, text) for name, limit, text in (
        ("a", 1, F.format_string("a(n=%d)", "n")), ("none", 1, F.lit(None).cast("string")), ("b", 7, F.format_string("b(n=%d)", "n")))]
    found = rows.select("id", fired_flags(made).alias("flags"))
    assert {r["id"]: r["flags"] for r in found.collect()} == {1: ["_rule_a:a(n=5)"], 2: [], 3: ["_rule_a:a(n=9)", "_rule_b:b(n=9)"]}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    cut = spark.createDataFrame([(["_rule_x:p(a=1)", "_rule_syn_flood:syn_flood(r=(2))"],), ([],)], "f array<string>")
    assert [tuple(r) for r in cut.select(alert_label(F.col("f"), F.lit("z")), rule_suffix(F.col("f"))).collect()] == [
        ("SYN Flood", "_rule_x:p,_rule_syn_flood:syn_flood"), ("z", "")]


def test_tables_are_written_without_sorting_by_partition(spark, tmp_path):
    df = spark.range(0, 1000, 1, 2).withColumn("part", F.col("id") % 3)
    write_tables({"t": df}, str(tmp_path), {"t": ["part"]})
    files = list((tmp_path / "t").glob("part=*/*.parquet"))
    assert len(files) == 6 and all(".zstd." in f.name for f in files)
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 3
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).groupBy("part").count().collect())) == [(0, 334), (1, 333), (2, 333)]


def test_stream_assembles_packets_of_null_number_keys(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(None if n % 3 == 0 else n % 3, None if n % 2 else 7, pd.Timestamp(int(t), unit="ms").to_pydatetime(), "fwd" if n % 5 else "bwd", float(n % 11), "SYN")
            for n, t in enumerate(rng.permutation(240) * 700 + 1_700_000_000_000)]
    packets = spark.createDataFrame(rows, "src_key long, dst_key int, ts timestamp, direction string, pkt_size double, tcp_flag string")
    packets.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))
    limits = {"idle_ms": 5_000, "active_ms": 20_000}
    found = stream_assembly.assemble_stream(stream, delay="0 seconds", **limits)
    write_stream(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    assert got.schema["src_key"].dataType == packets.schema["src_key"].dataType
    wanted = assemble_flows(packets, **limits)

    def told(df):
        return {(r["src_key"], r["dst_key"], r["bidirectional_first_seen_ms"]): (
            r["bidirectional_last_seen_ms"], r["bidirectional_packets"], r["src2dst_bytes"], r["bidirectional_max_iat"]) for r in df.collect()}

    got, wanted = told(got), told(wanted)
    assert {k: v for k, v in wanted.items() if k in got} == got and any(k[0] is None for k in got)
    # left in the state: the last flow of a key, where it is still open
    left = [k for k in wanted if k not in got]
    assert len({k[:2] for k in left}) == len(left) and all(k[2] == max(x[2] for x in wanted if x[:2] == k[:2]) for k in left)
