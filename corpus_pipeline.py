"""Corpus pipeline: toxic documents go, of copies and near copies one stays, benchmark content goes, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``docs``. Counted as part of the llm subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigauge.llm import decontam, exact_dedup, minmax, pieces, toxicity
from lexigauge.llm.base import materialise, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model learns from the labels of the documents given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row with the largest doc_id."""
    return exact_dedup.keep_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of their five-word shingles the row with the smallest doc_id."""
    return minmax.keep_distinct(docs, k=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, also re-parameterised ones."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that is left, and whether decoding gave its text."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Trained models, signatures and transducers have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
