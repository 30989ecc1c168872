"""Counters of a running stream by observation: no second pass over the batch, one stored row per batch."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.reports import error_count, flow_counters

NAME = "flow_counters"
COUNTERS = ("flows", "attack", "suspect", "anomaly", "benign", "rule_hits", "rule_raised", "errors")
_SCHEMA = "query_id string, batch_id long, seconds double, " + ", ".join(f"{c} long" for c in COUNTERS)


def observed(scored: DataFrame) -> DataFrame:
    """The scored stream itself; its counters are reported with the progress of every batch."""
    return scored.observe(NAME, *flow_counters(), error_count())


class CounterLog(StreamingQueryListener):
    """Stores the observed counters of every batch of every stream of a session below ``path``.

    A batch that runs again stores its row again; :func:`counter_totals` reads the last one of each batch. Use as a context
    manager round the streams to be counted; leaving it waits for ``queries`` that ended to have reported.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def __enter__(self) -> CounterLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def wait(self, query: StreamingQuery, timeout_s: float = 60.0) -> None:
        """Until the query has ended and its last batch is stored."""
        query.awaitTermination()
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, timeout_s):
                raise TimeoutError("the stream's progress was not reported")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(NAME)
        if row is None:
            return
        seconds = progress.durationMs.get("triggerExecution", 0) / 1000
        values = (str(progress.id), progress.batchId, seconds, *[row[c] for c in COUNTERS])
        self.spark.createDataFrame([values], _SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()


def counter_totals(log: DataFrame) -> DataFrame:
    """Totals over all batches, with ``flows_per_second`` of the time the batches took; each batch counts once."""
    last = log.groupBy("query_id", "batch_id").agg(F.max_by(F.struct("seconds", *COUNTERS), "seconds").alias("r")).select("r.*")
    totals = last.agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum("seconds").alias("seconds"))
    return totals.withColumn("flows_per_second", F.when(F.col("seconds") > 0, F.col("flows") / F.col("seconds")).otherwise(0.0)).drop("seconds")
