"""The correlation job: which features repeat others, stored as a report and a pruned feature list for training."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.profile import correlations, high_correlations, pruned_features, pruning_summary, redundant_columns
from ..session import materialise
from ..sources.tables import feature_table, write_json
from .offline import Prepared

_LIST = "position int, feature string"


@dataclass
class Audit:
    """Pairs at or above the threshold, columns to drop, the features that stay (position, feature), and one row of counts."""

    pairs: DataFrame
    dropped: DataFrame
    pruned: DataFrame
    summary: DataFrame


def audit_correlations(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> Audit:
    """One pass over the rows; everything after it is bounded by the number of features."""
    listed = feature_table(df.sparkSession, features)
    pairs = high_correlations(correlations(df, features), threshold)
    dropped = materialise(redundant_columns(pairs))
    pruned = pruned_features(listed, dropped).select("position", "feature")
    return Audit(pairs, dropped, pruned, pruning_summary(listed, pairs, dropped, threshold))


def save_audit(audit: Audit, root: str) -> None:
    """Four JSON tables below ``root``: ``pairs``, ``dropped``, ``feature_list_pruned``, ``summary``."""
    for name, df in {"pairs": audit.pairs, "dropped": audit.dropped, "feature_list_pruned": audit.pruned, "summary": audit.summary}.items():
        write_json(df, root, name)


def load_audit(spark: SparkSession, root: str) -> Audit:
    return Audit(
        spark.read.schema("i int, j int, feat_a string, feat_b string, correlation double, drop_candidate string").json(f"{root}/pairs"),
        spark.read.schema("dropped string").json(f"{root}/dropped"),
        spark.read.schema(_LIST).json(f"{root}/feature_list_pruned"),
        spark.read.schema("threshold double, n_original_features long, n_pruned_features long, n_dropped long, n_pairs_found long").json(f"{root}/summary"),
    )


def listed_features(table: DataFrame) -> list[str]:
    """A feature list in its order; bounded by the number of features."""
    return [r["feature"] for r in table.orderBy("position").collect()]


def with_features(p: Prepared, features: Sequence[str]) -> Prepared:
    """The prepared tables for training on some of the features only, those of the stored pruned list for instance."""
    unknown = set(features) - set(p.features)
    if unknown:
        raise ValueError(f"not prepared: {sorted(unknown)}")
    place = {f: i for i, f in enumerate(p.features)}

    def narrowed(scaler: DataFrame) -> DataFrame:
        return scaler.select(F.struct(*[F.col(f"scaler.f{place[f]}").alias(f"f{i}") for i, f in enumerate(features)]).alias("scaler"))

    gone = [f"`{f}`" for f in p.features if f not in set(features)]
    kept = p.marked.select(*[F.col(f"`{c}`") for c in p.marked.columns if f"`{c}`" not in gone])
    return replace(p, marked=kept, features=list(features), scaler=narrowed(p.scaler), benign_scaler=narrowed(p.benign_scaler))
