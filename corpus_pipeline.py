"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
to the shared folder and rereads it as the next stage's input. All stages take NULL texts as
empty ones, NULL ids as ids and whole texts of any length, keep columns of any further name, and
give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowwarden.llm.jaccard_join import one_per_component
from flowwarden.llm.line_dedup import dedup_lines
from flowwarden.llm.mixing import WORD, mixed_documents
from flowwarden.llm.packing import pack_documents
from flowwarden.llm.store import stored
from flowwarden.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Texts alone decide: repeated rows share their fate, empty and NULL texts have a score like any other.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return without_toxic(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, and with them documents of which no word is left.

    Documents that had no words before stay, NULL texts as NULL. ``n_chars`` follows the text. Documents come in
    the order of doc_id (NULL first), then of a hash of the text; rows equal in both lose and keep the same lines.
    """
    cleaned = dedup_lines(docs)
    words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    changed = cleaned.where((F.col("n_removed") == 0) | words)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id (NULL last), then the smallest text hash.

    Of rows equal in doc_id and text one stays; documents without words all stay.
    """
    return one_per_component(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents of small sources repeat, those of large ones thin out.

    A NULL source is a source, the last. A document that is taken more than once makes as many rows, the last cut after
    its last word taken; documents without words, of which nothing can be taken, go. Equal rows are pooled into one.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All token pieces with their ids and places in sequences of 2048 tokens.

    Copies of a document are packed like any rows; ``packing.joined_sequences`` makes the sequences of the result.
    """
    return pack_documents(docs.select("doc_id", "text"), keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("packing", packing),
]

#: Several stages have no SQL form; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
