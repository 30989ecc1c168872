"""Flow assembly on a packet stream, with the records of :mod:`operators.assembly`.

Packets of equal key and millisecond are merged by a streaming aggregation, before the shuffle as well, and come to the
assembler once the watermark has passed them: each time once and in order. The state of a key is the sums of its one open flow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT
from ..operators.assembly import FLAGS, SIDES, flow_records, packet_sums

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_GAPS = ("bidirectional", *SIDES)
_COUNTS = [f"{s}_{c}" for s in SIDES for c in ("n", "psh", "urg")] + [f"n_{f.lower()}" for f in FLAGS]
_SIZES = [f"{s}_{c}" for s in SIDES for c in ("sum", "sq")]
_LEAST = [f"{s}_min" for s in SIDES] + [f"{g}_min_iat" for g in _GAPS]
_MOST = [f"{s}_max" for s in SIDES] + [f"{g}_max_iat" for g in _GAPS]
_SPAN = ["first", "last", *[f"{s}_{c}" for s in SIDES for c in ("first", "last")]]
_GAP_SUMS = [f"{g}_{c}" for g in _GAPS for c in ("gaps", "gap_sum", "gap_sq")]
#: the sums of an open flow, all kept as doubles (NULL: none yet); times and counts stay whole numbers below 2^53
_FIELDS = [*_SPAN, *_COUNTS, *_SIZES, *_LEAST, *_MOST, *_GAP_SUMS]


_AT = {f: i for i, f in enumerate(_FIELDS)}
#: the sums of one key and millisecond, in the order they travel in
_ADDED, _LOWEST, _HIGHEST = [*_COUNTS, *_SIZES], [f"{s}_min" for s in SIDES], [f"{s}_max" for s in SIDES]
_SENT = {f: i for i, f in enumerate([*_ADDED, *_LOWEST, *_HIGHEST])}
_ADDED_AT, _LOWEST_AT, _HIGHEST_AT = ([_AT[f] for f in fields] for fields in (_ADDED, _LOWEST, _HIGHEST))
_KEPT_SUMS = [_AT[f] for f in (*_ADDED, *_GAP_SUMS)]
_KEPT_LEAST = [_AT[f] for f in (*_LEAST, "first", *[f"{s}_first" for s in SIDES])]
_KEPT_MOST = [_AT[f] for f in (*_MOST, "last", *[f"{s}_last" for s in SIDES])]


def _flow_starts(t: np.ndarray, first: float | None, idle: int, active: int) -> np.ndarray:
    """Places where a flow begins, for times in order; ``first`` is the start of the open flow that the first time belongs to."""
    breaks = [0, *(np.flatnonzero(np.diff(t) >= idle) + 1).tolist(), len(t)]
    starts = []
    for at, end in zip(breaks[:-1], breaks[1:]):
        start = t[at] if at or first is None else first
        while at < end:
            starts.append(at)
            at = int(np.searchsorted(t, start + active)) if t[end - 1] >= start + active else end
            start = t[at] if at < end else start
    return np.array(starts)


def _flow_sums(t: np.ndarray, sums: np.ndarray, starts: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The sums of all flows of a key, a row each; the first one goes on from the open flow ``before``, if there is one."""
    flows = np.full((len(starts), len(_FIELDS)), np.nan)
    flow = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(t)))
    flows[:, _ADDED_AT] = np.add.reduceat(np.nan_to_num(sums[:, : len(_ADDED)]), starts)
    flows[:, _LOWEST_AT] = np.fmin.reduceat(sums[:, [_SENT[f] for f in _LOWEST]], starts)
    flows[:, _HIGHEST_AT] = np.fmax.reduceat(sums[:, [_SENT[f] for f in _HIGHEST]], starts)
    counts = {s: sums[:, _SENT[f"{s}_n"]] for s in SIDES}
    counts["bidirectional"] = sum(counts.values())
    for name in _GAPS:
        whole = name == "bidirectional"
        first, last = ("first", "last") if whole else (f"{name}_first", f"{name}_last")
        seen = slice(None) if whole else counts[name] > 0
        at, of, n = t[seen].astype(float), flow[seen], counts[name][seen]
        previous = np.append(np.nan if before is None else before[_AT[last]], at[:-1])[: len(at)]
        # a gap counts where it ends with a packet of a direction known to the meter
        ends = (np.diff(of, prepend=0) == 0) & ~np.isnan(previous) & (n > 0)
        gaps, owner = (at - previous)[ends], of[ends]
        size = len(starts)
        flows[:, _AT[f"{name}_gaps"]] = np.bincount(of, np.maximum(n - 1, 0), size) + np.bincount(owner, minlength=size)
        flows[:, _AT[f"{name}_gap_sum"]] = np.bincount(owner, gaps, size)
        flows[:, _AT[f"{name}_gap_sq"]] = np.bincount(owner, gaps * gaps, size)
        least, most = flows[:, _AT[f"{name}_min_iat"]], flows[:, _AT[f"{name}_max_iat"]]
        np.fmin.at(least, owner, gaps)
        np.fmax.at(most, owner, gaps)
        least[of[n > 1]] = 0.0
        np.fmin.at(flows[:, _AT[first]], of, at)
        np.fmax.at(flows[:, _AT[last]], of, at)
    if before is not None:
        flows[0, _KEPT_SUMS] += before[_KEPT_SUMS]
        flows[0, _KEPT_LEAST] = np.fmin(flows[0, _KEPT_LEAST], before[_KEPT_LEAST])
        flows[0, _KEPT_MOST] = np.fmax(flows[0, _KEPT_MOST], before[_KEPT_MOST])
    return flows


class _Assembler(StatefulProcessor):
    """One open flow per key; it ends by the idle gap, or by the active cap with the packet that opens the next one.

    All flows of a key in a batch are summed together. A flow whose idle gap the watermark has passed is handed on at once;
    only the others are kept, each with one timer at the end of its gap.
    """

    def __init__(self, keys: Sequence[str], idle_ms: int, active_ms: int):
        self.keys, self.idle, self.active = list(keys), idle_ms, active_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "sums array<double>")

    def _open(self) -> np.ndarray | None:
        kept = self.state.get()
        return None if kept is None else np.array(kept[0], dtype=float)

    def _frame(self, key, flows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * len(flows) for k, v in zip(self.keys, key)}, "sums": list(flows)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        t = np.concatenate([f["packet_ms"].to_numpy(np.int64) for f in frames])
        sums = np.array([x for f in frames for x in f["sums"]], dtype=float)
        order = np.argsort(t, kind="stable")
        t, sums = t[order], sums[order]
        kept = before = self._open()
        done = []
        if before is not None and (t[0] - before[_AT["last"]] >= self.idle or t[0] - before[_AT["first"]] >= self.active):
            done.append(before[None])
            before = None
        starts = _flow_starts(t, None if before is None else before[_AT["first"]], self.idle, self.active)
        flows = _flow_sums(t, sums, starts, before)
        over = int(t[-1]) + self.idle <= timerValues.getCurrentWatermarkInMs()
        done.append(flows if over else flows[:-1])
        if kept is not None:
            self.handle.deleteTimer(int(kept[_AT["last"]]) + self.idle)
        if not over:
            self.state.update((flows[-1].tolist(),))
            self.handle.registerTimer(int(t[-1]) + self.idle)
        elif kept is not None:
            self.state.clear()
        if len(found := np.concatenate(done)):
            yield self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (flow := self._open()) is not None:
            self.state.clear()
            yield self._frame(key, flow[None])

    def close(self) -> None:
        pass


def assemble_stream(
    packets: DataFrame,
    keys: Sequence[str] = ("src_key", "dst_key"),
    idle_ms: int = DEFAULT.idle_timeout_ms,
    active_ms: int = DEFAULT.active_timeout_ms,
    delay: str = "1 minute",
) -> DataFrame:
    """Flow-meter records of a packet stream, on every field those of :func:`operators.assembly.assemble_flows`.

    A flow is emitted once the watermark, ``delay`` behind the latest packet, has passed its idle gap, or the packet that
    reached the active cap. Packets later than the watermark are dropped by Spark and counted in the query progress.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    keys = list(keys)
    at = F.timestamp_millis(F.unix_millis("ts")).alias("_event_time")
    timed = packets.select(*keys, at, "direction", "pkt_size", "tcp_flag").withWatermark("_event_time", delay)
    merged = timed.groupBy(*keys, "_event_time").agg(*packet_sums())
    # one array of sums each way: what a key costs in the workers is mostly columns; keys travel as text, where NULL equals NULL
    sent = F.array(*[F.col(f).cast("double") for f in _SENT])
    fields = [*[T.StructField(k, T.StringType()) for k in keys], T.StructField("sums", T.ArrayType(T.DoubleType()))]
    named_keys = [F.col(k).cast("string").alias(k) for k in keys]
    flows = merged.select(*named_keys, "_event_time", F.unix_millis("_event_time").alias("packet_ms"), sent.alias("sums")).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Assembler(keys, idle_ms, active_ms), outputStructType=T.StructType(fields), outputMode="append", timeMode="eventTime")
    # NaN: none
    own_keys = [F.col(k).cast(packets.schema[k].dataType).alias(k) for k in keys]
    sums = flows.select(*own_keys, *[F.when(~F.isnan(F.col("sums")[i]), F.col("sums")[i]).alias(f) for f, i in _AT.items()])
    whole = [*_SPAN, *_COUNTS, *[f"{g}_gaps" for g in _GAPS]]
    sums = sums.withColumns({f: F.col(f).cast("bigint") for f in whole})
    named = {
        "bidirectional_first_seen_ms": F.col("first"), "bidirectional_last_seen_ms": F.col("last"),
        **{f"bidirectional_{f.lower()}_packets": F.col(f"n_{f.lower()}") for f in FLAGS},
        **{f"{s}_duration": F.coalesce(F.col(f"{s}_last") - F.col(f"{s}_first"), F.lit(0)) for s in SIDES},
        **{f"{g}_{c}_iat": F.coalesce(f"{g}_{c}_iat", F.lit(0.0)) for g in _GAPS for c in ("min", "max")},
    }
    return flow_records(sums.withColumns(named), keys)
