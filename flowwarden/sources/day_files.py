"""Raw capture-day CSV files: header profile and scan."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FILE_COLUMN = "source_file"
HEADER_BYTES = 1 << 16


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """CSV files below ``root``: path, length. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root)
    )
    return files.select("path", "length")


def _first_lines(batches):
    from pyarrow import fs

    for pdf in batches:
        headers = []
        for path in pdf["path"]:
            uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
            system, inner = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(inner) as stream:
                text = b""
                while b"\n" not in text:
                    more = stream.read(HEADER_BYTES)
                    if not more:
                        break
                    text += more
            line = text.split(b"\n", 1)[0].decode("utf-8").lstrip("﻿").rstrip("\r")
            headers.append(next(csv.reader([line]), []))
        yield pdf.assign(header=headers)


def file_headers(spark: SparkSession, root: str) -> DataFrame:
    """Header of every file: path, length, header. Tasks read only the first bytes of a file."""
    files = list_files(spark, root)
    if files.isEmpty():
        raise FileNotFoundError(f"no CSV files below {root}")
    schema = T.StructType(files.schema.fields + [T.StructField("header", T.ArrayType(T.StringType()))])
    return files.repartition("path").mapInPandas(_first_lines, schema)


def header_profile(headers: DataFrame, name_column: str = "file") -> DataFrame:
    """Per file: column count, columns missing or extra against the first file, label candidates."""
    named = headers.select(
        F.element_at(F.split("path", "/"), -1).alias(name_column), F.transform("header", F.trim).alias("header")
    )
    reference = named.agg(F.min_by("header", name_column).alias("ref")).scalar()
    return named.select(
        name_column,
        F.size("header").cast("bigint").alias("n_columns"),
        F.sort_array(F.array_except("header", reference)).alias("extra"),
        F.sort_array(F.array_except(reference, F.col("header"))).alias("missing"),
        F.filter("header", lambda c: F.lower(c).contains("label")).alias("label_candidates"),
    )


def read_day_files(spark: SparkSession, root: str) -> DataFrame:
    """All day files as one text frame with the file name in ``source_file``.

    A CSV scan assigns columns by position, so files are read in one scan per
    distinct header and united by name; absent columns become NULL.
    """
    layouts = file_headers(spark, root).groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    frames = []
    for layout in sorted(layouts, key=lambda r: r["header"]):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in layout["header"]])
        frame = spark.read.option("header", True).schema(schema).csv(sorted(layout["paths"]))
        frames.append(
            frame.withColumn(FILE_COLUMN, F.col("_metadata.file_name"))
            .toDF(*[c.strip() for c in layout["header"]], FILE_COLUMN)
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
