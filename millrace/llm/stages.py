"""The corpus pipeline's stages: an operator's decisions applied to documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, packing, quality_classifier, secrets

#: Near copies share four fifths of their five-word shingles; ``op3``'s own rule binds that query alone.
NEAR = jaccard_join.Rule(shingle=5, percent=80)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return quality_classifier.keep(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component (the least id) and every document without id."""
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        found = jaccard_join.join_components(docs, rule=NEAR)
        gone = found.filter("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # Ids repeat, so rows (id and text) are decided.
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.withColumn("_row", row)
    found = jaccard_join.join_components(keyed, key="_row", rule=NEAR).filter("doc_id IS NOT NULL")
    found = found.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = keyed.filter("_row IS NOT NULL").select("_row", "doc_id").distinct()
    kept = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("_kept"))
    # Rows that repeat as a whole, or with other metadata only: one of each stays.
    left = keyed.join(kept.select("_kept._row"), "_row", "left_semi").dropDuplicates(["_row"])
    return left.unionByName(keyed.filter("_row IS NULL")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    found = decontamination.contaminated(rows, _table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select("_row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without findings; the others are quarantined whole."""
    row = F.xxhash64("doc_id", "text")
    _, found = secrets.scan_versions(docs.select(row.alias("path"), "text"))
    hit = found.filter(F.size("findings") > 0).select(F.col("path").alias("_row")).distinct()
    return docs.withColumn("_row", row).join(hit, "_row", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
