"""Cleaning of raw text flow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.numeric import col, finite, to_number
from ..schema import BENIGN, IDENTITY_COLUMNS, LABEL, TIMESTAMP_COLUMNS, ZERO_BULK_COLUMNS


def trim_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def trim_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Strip blanks around label values; a missing label becomes the text ``nan``."""
    return df.withColumn(label, F.coalesce(F.trim(col(label)), F.lit("nan")))


def drop_identity(df: DataFrame) -> DataFrame:
    return df.drop(*IDENTITY_COLUMNS, *TIMESTAMP_COLUMNS)


def drop_zero_bulk(df: DataFrame) -> DataFrame:
    return df.drop(*ZERO_BULK_COLUMNS)


def drop_repeated_headers(df: DataFrame, label: str = LABEL, observe: Observation | None = None) -> DataFrame:
    """Remove header rows repeated inside the data; their number goes to ``observe``."""
    if observe is not None:
        df = df.observe(observe, F.count_if(col(label) == label).alias("header_rows"))
    return df.filter(col(label) != label)


def benign_rows(df: DataFrame, label: str = LABEL, benign: str = BENIGN) -> DataFrame:
    return df.filter(col(label) == benign)


def attack_rows(df: DataFrame, label: str = LABEL, benign: str = BENIGN) -> DataFrame:
    return df.filter(col(label) != benign)


def class_pair(df: DataFrame, first: str, second: str, label: str = LABEL) -> DataFrame:
    return df.filter(col(label).isin(first, second))


def feature_columns(df: DataFrame, not_features: Sequence[str] = (LABEL, "label_enc", "source_file")) -> list[str]:
    return [c for c in df.columns if c not in not_features]


def force_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to double; text that is no number becomes NULL."""
    return df.withColumns({c: to_number(col(c)) for c in columns})


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """NULL and NaN to ``value``, infinities kept."""
    return df.withColumns({c: F.coalesce(F.nanvl(col(c), F.lit(value)), F.lit(value)) for c in columns})


def fill_non_finite(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """NULL, NaN and infinities to ``value``."""
    return df.withColumns({c: finite(col(c), value) for c in columns})


def load_ready(raw: DataFrame, label: str = LABEL, observe: Observation | None = None) -> DataFrame:
    """Names and labels trimmed, identity and time columns and repeated headers gone."""
    return drop_repeated_headers(drop_identity(trim_labels(trim_names(raw), label)), label, observe)


def clean(df: DataFrame, label: str = LABEL, keep: Sequence[str] = ("source_file",)) -> DataFrame:
    """Text records to finite numbers: one projection, no shuffle."""
    slim = drop_zero_bulk(df)
    columns = feature_columns(slim, (label, "label_enc", *keep))
    numbers = force_numeric(slim, columns)
    if "Flow Byts/s" in columns:
        numbers = fill_missing(numbers, ["Flow Byts/s"])
    return fill_non_finite(numbers, columns)
