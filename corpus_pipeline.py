"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, packing, secretscan, simhash, toxicity
from tidemark.llm._base import in_fold, materialise, without_rows


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; a null or empty text is kept unless labelled texts like it are toxic.

    Rows are judged by their text alone, so repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~in_fold(F.col("doc_id"), 3, 1))
    return toxicity.reject(docs, toxicity.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id; null texts count as empty.

    Of rows that repeat id and text the one with the smallest hash over all columns stays.
    """
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; null ids are larger than any other.

    Texts that share an id are documents of their own; rows that repeat id and text stay or go together.
    """
    groups = simhash.near_duplicates(docs)
    return without_rows(docs, materialise(groups.where(~F.col("kept")).select("doc_id", "text_hash").distinct(), "gone"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked that are not widely copied examples; ``n_chars`` follows the text.

    Repeated rows get equal texts.
    """
    return secretscan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; repeated rows are packed like any other."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing_stage),
]

#: Tokenising and scoring have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
