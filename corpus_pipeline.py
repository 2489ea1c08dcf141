"""The corpus pipeline: raw documents to packed training sequences.

Each stage's result is written as Parquet to the shared folder and read again
as the next one's documents, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import stages
from millrace.llm.shared import stored

STAGES = [
    ("quality_classifier", stages.quality),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("benchmark_decontamination", stages.decontaminate),
    ("secret_scan", stages.without_secrets),
    ("packing", stages.pack),
]

#: Sampling by a trained classifier and sub-word packing are beyond SQL; tests hold each stage
#: against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, as ``packing.pack`` returns them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
