"""Assembly of packets into bidirectional flow records.

A flow ends after an idle gap, or when a packet arrives at or past the active
cap counted from the flow's first packet; that packet opens the next flow.

Packets of equal key and millisecond are merged first (this combines on the map
side), and a key is cut into time slices. Neighbour lookups run in windows over
(key, slice); what a slice needs from the slices before it comes from one
summary row per slice. No task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT
from ..functions.joins import null_safe_join
from .chains import chain_owner

FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "CWR", "ECE")
SIDES = {"src2dst": "fwd", "dst2src": "bwd"}


def packet_sums() -> list[Column]:
    """Counts, sizes and flags of packets per direction."""
    size, flag, way = F.col("pkt_size"), F.col("tcp_flag"), F.col("direction")
    aggs = []
    for side, value in SIDES.items():
        mine = way == value
        aggs += [
            F.count_if(mine).alias(f"{side}_n"),
            F.sum(F.when(mine, size)).alias(f"{side}_sum"),
            F.sum(F.when(mine, size * size)).alias(f"{side}_sq"),
            F.min(F.when(mine, size)).alias(f"{side}_min"),
            F.max(F.when(mine, size)).alias(f"{side}_max"),
            F.count_if(mine & (flag == "PSH")).alias(f"{side}_psh"),
            F.count_if(mine & (flag == "URG")).alias(f"{side}_urg"),
        ]
    aggs += [F.count_if(flag == f).alias(f"n_{f.lower()}") for f in FLAGS]
    return aggs


def _merge_packets(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and millisecond."""
    return packets.groupBy(*keys, F.unix_millis("ts").alias("_t")).agg(*packet_sums())


def _with_last_seen(df: DataFrame, keys: Sequence[str], marks: dict[str, Column], inclusive: bool) -> DataFrame:
    """For each mark (a time, NULL where absent) the latest one before the row, or up to it if ``inclusive``."""
    names = list(marks)
    marked = df.withColumns({f"_m_{n}": m for n, m in marks.items()})
    local = W.partitionBy(*keys, "_slice").orderBy("_t").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    inside = marked.withColumns({f"_in_{n}": F.last(f"_m_{n}", True).over(local) for n in names})
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*keys, "_slice").agg(*[F.max(f"_m_{n}").alias(f"_max_{n}") for n in names])
        .select(*keys, "_slice", *[F.last(f"_max_{n}", True).over(earlier).alias(f"_carry_{n}") for n in names])
    )
    joined = null_safe_join(inside, carried, [*keys, "_slice"])
    return joined.withColumns({n: F.coalesce(F.col(f"_in_{n}"), F.col(f"_carry_{n}")) for n in names}).drop(
        *[f"{p}{n}" for n in names for p in ("_m_", "_in_", "_carry_")]
    )


def _with_flow_start(
    packets: DataFrame, keys: Sequence[str], idle_ms: int, active_ms: int, slice_ms: int
) -> DataFrame:
    merged = _merge_packets(packets, keys).withColumn("_slice", F.floor(F.col("_t") / F.lit(slice_ms)))
    t = F.col("_t")
    seen = _with_last_seen(merged, keys, {
        "_prev": t,
        "_prev_src2dst": F.when(F.col("src2dst_n") > 0, t),
        "_prev_dst2src": F.when(F.col("dst2src_n") > 0, t),
    }, inclusive=False)
    opens = F.col("_prev").isNull() | (t - F.col("_prev") >= idle_ms)
    sessions = _with_last_seen(seen, keys, {"_session": F.when(opens, t)}, inclusive=True)
    # the active cap concerns only sessions that last as long as the cap
    owners = [*keys, "_session"]
    longest = sessions.groupBy(*owners).agg(F.max("_t").alias("_end")).filter(F.col("_end") - F.col("_session") >= active_ms).drop("_end")
    events = null_safe_join(sessions, longest, owners).select(*owners, "_t", F.lit(1).cast("bigint").alias("_n"))
    capped = chain_owner(events, owners, active_ms)
    return null_safe_join(sessions, capped, [*owners, "_t"], "left").withColumn("_flow", F.coalesce("_start", "_session")).drop("_start")


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from count, sum and sum of squares; 0 below two values."""
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1)))).otherwise(0.0)


def _mean(n: Column, total: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(0.0)


def assemble_flows(
    packets: DataFrame,
    keys: Sequence[str] = ("src_key", "dst_key"),
    idle_ms: int = DEFAULT.idle_timeout_ms,
    active_ms: int = DEFAULT.active_timeout_ms,
    slice_ms: int = 10_000,
) -> DataFrame:
    """Flow-meter records of the packets.

    Input columns: the keys, ``ts``, ``direction`` (fwd/bwd), ``pkt_size``,
    ``tcp_flag``. Times are milliseconds; deviations are sample deviations.
    """
    rows = _with_flow_start(packets, keys, idle_ms, active_ms, slice_ms)
    t, flow = F.col("_t"), F.col("_flow")
    both = F.col("src2dst_n") + F.col("dst2src_n")
    gaps = {"bidirectional": (both, F.col("_prev"))}
    gaps |= {s: (F.col(f"{s}_n"), F.col(f"_prev_{s}")) for s in SIDES}
    aggs = [F.min("_t").alias("bidirectional_first_seen_ms"), F.max("_t").alias("bidirectional_last_seen_ms")]
    for name, (n, previous) in gaps.items():
        gap = F.when((n > 0) & (previous >= flow), (t - previous).cast("double"))
        # packets of the same millisecond are zero apart
        aggs += [
            (F.sum(F.greatest(n - 1, F.lit(0))) + F.count(gap)).alias(f"{name}_gaps"),
            F.coalesce(F.sum(gap), F.lit(0.0)).alias(f"{name}_gap_sum"),
            F.coalesce(F.sum(gap * gap), F.lit(0.0)).alias(f"{name}_gap_sq"),
            F.coalesce(F.least(F.min(gap), F.min(F.when(n > 1, 0.0))), F.lit(0.0)).alias(f"{name}_min_iat"),
            F.coalesce(F.max(gap), F.lit(0.0)).alias(f"{name}_max_iat"),
        ]
    for s in SIDES:
        mine = F.when(F.col(f"{s}_n") > 0, t)
        aggs += [F.sum(f"{s}_{c}").alias(f"{s}_{c}") for c in ("n", "psh", "urg")]
        aggs += [F.coalesce(F.sum(f"{s}_{c}"), F.lit(0.0)).alias(f"{s}_{c}") for c in ("sum", "sq")]
        aggs += [F.min(f"{s}_min").alias(f"{s}_min"), F.max(f"{s}_max").alias(f"{s}_max")]
        aggs.append(F.coalesce(F.max(mine) - F.min(mine), F.lit(0)).alias(f"{s}_duration"))
    aggs += [F.sum(f"n_{f.lower()}").alias(f"bidirectional_{f.lower()}_packets") for f in FLAGS]
    return flow_records(rows.groupBy(*keys, "_flow").agg(*aggs), keys)


def flow_records(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flow-meter records from the sums of each flow."""
    gaps = ("bidirectional", *SIDES)
    c = F.col
    n, total, squares = c("src2dst_n") + c("dst2src_n"), c("src2dst_sum") + c("dst2src_sum"), c("src2dst_sq") + c("dst2src_sq")
    out = {
        "bidirectional_first_seen_ms": c("bidirectional_first_seen_ms"),
        "bidirectional_last_seen_ms": c("bidirectional_last_seen_ms"),
        "bidirectional_duration_ms": c("bidirectional_last_seen_ms") - c("bidirectional_first_seen_ms"),
        "bidirectional_packets": n,
        "bidirectional_bytes": total,
        "bidirectional_min_ps": F.coalesce(F.least("src2dst_min", "dst2src_min"), F.lit(0.0)),
        "bidirectional_max_ps": F.coalesce(F.greatest("src2dst_max", "dst2src_max"), F.lit(0.0)),
        "bidirectional_mean_ps": _mean(n, total),
        "bidirectional_stddev_ps": _deviation(n, total, squares),
    }
    for s in SIDES:
        out |= {
            f"{s}_packets": c(f"{s}_n"), f"{s}_bytes": c(f"{s}_sum"), f"{s}_duration": c(f"{s}_duration"),
            f"{s}_min_ps": F.coalesce(f"{s}_min", F.lit(0.0)), f"{s}_max_ps": F.coalesce(f"{s}_max", F.lit(0.0)),
            f"{s}_mean_ps": _mean(c(f"{s}_n"), c(f"{s}_sum")),
            f"{s}_stddev_ps": _deviation(c(f"{s}_n"), c(f"{s}_sum"), c(f"{s}_sq")),
            f"{s}_psh_packets": c(f"{s}_psh"), f"{s}_urg_packets": c(f"{s}_urg"),
        }
    for name in gaps:
        k = c(f"{name}_gaps")
        out |= {
            f"{name}_min_iat": c(f"{name}_min_iat"), f"{name}_max_iat": c(f"{name}_max_iat"),
            f"{name}_mean_iat": _mean(k, c(f"{name}_gap_sum")),
            f"{name}_stddev_iat": _deviation(k, c(f"{name}_gap_sum"), c(f"{name}_gap_sq")),
        }
    out |= {f"bidirectional_{f.lower()}_packets": c(f"bidirectional_{f.lower()}_packets") for f in FLAGS}
    return flows.select(*keys, *[v.alias(k) for k, v in out.items()])
