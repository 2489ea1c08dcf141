"""Bounded samples of labelled documents for the trained models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are used to fit a classifier.
MAX_LABELLED = 20_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text and ``label`` of the ``limit`` training rows that come first in hash order.

    The chosen ids number ``limit`` at most, so they are broadcast and only their
    texts are shuffled: of an id that repeats, the least text counts.  Ids that are
    null or labelled inconsistently are left out.
    """
    one = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias(label), F.max(label).alias("_max"))
        .filter(F.col(label) == F.col("_max"))
        .filter(fold(F.col("doc_id")) != 0)
    )
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", label)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label)


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row of those whose texts share the least hash of their three-word shingles.

    Near copies nearly always do, other texts hardly ever; a family of copies
    then counts about once.
    """
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_words") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    keyed = rows.withColumn("_words", words).withColumn("_key", F.array_min(shingles)).drop("_words")
    return keyed.dropDuplicates(["_key"]).drop("_key")
