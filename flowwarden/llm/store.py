"""Stored intermediate tables and session settings shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path

# Bounds for one Arrow batch, so that long texts do not fill a task's memory.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def session_of(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches bounded in rows and bytes."""
    spark = df.sparkSession
    for key, value in _BATCH.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def whole_row(df: DataFrame):
    """All columns as the struct ``row``, so that their names cannot clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


Batches = Iterator[pa.RecordBatch]


def key_of_doc(column: str = "doc_id"):
    """doc_id as a long that is never NULL; NULL becomes the smallest id."""
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(-(2**63)))
