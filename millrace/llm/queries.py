"""The registered queries of this subpackage: thin calls of its operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    audit_sql, chat, decontamination, divergence, histogram_packing, jaccard_join, packing, pii, quality_classifier,
    quality_rules, secrets, suffix_dedup, toxicity, vector_codes,
)
from millrace.llm.oracles import ORACLES
from millrace.llm.shared import shared_folder, stored
from millrace.sources.tables import table as _table

#: Tokenizer files; a cluster may keep them elsewhere.
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_MODEL)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = secrets.scan_versions(_table(spark, sf_dir, "documents"), path="doc_id")
    return secrets.digest(found)


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the labelled documents first, then all; findings of the second, with
    whether the first had scanned the text already."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    labelled = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    secrets.scan_into(path, labelled, path="doc_id")
    before = stored(spark.read.parquet(path).select("blob", F.lit(True).alias("known")))
    found = secrets.scan_into(path, docs, path="doc_id")
    found = found.join(before, "blob", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return found.select(F.col("path").alias("doc_id"), "known", F.size("findings").cast("long").alias("n_findings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


#: Both rows of conversation -7.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat.digest(rows.unionByName(more), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.apply_policy(ledger, quality_rules.POLICIES["full-1"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "fail_bits",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).drop("evaluated")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack(_table(spark, sf_dir, "documents"), WORD_MODEL)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_pii, op3_jaccard_join, op4_secret_scan, op5_suffix_dedup, op6_toxicity, op7_chat, op8_decontamination,
        op9_quality_rules, op10_quality_classifier, op11_vector_codes, op12_source_divergence, op13_best_fit_packing,
        secret_ledger,
    )
}
ORACLES |= {"op11_vector_codes": audit_sql.VECTOR_CODES, "op12_source_divergence": audit_sql.DIVERGENCE}
