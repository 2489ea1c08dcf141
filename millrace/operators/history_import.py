"""Arithmetic records of earlier runs, taken into one ledger by file: unchanged files are not read again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import arithmetic
from millrace.sources import changed_files

RECORD = "position bigint, expression string, answer string, status string"
ROWS = "file string, position bigint, expression string, fingerprint string, issue string"


class Imported(NamedTuple):
    ledger: DataFrame
    totals: DataFrame
    files: int
    read: int


def _derived(spark: SparkSession, paths: list[str]) -> DataFrame:
    records = spark.read.schema(RECORD).json(paths).select(F.col("_metadata.file_path").alias("file"), "*")
    # An operation that failed before it made a question is no record.
    failed = F.col("status").isin("quarantined", "skipped") & F.col("expression").isNull() & F.col("answer").isNull()
    checked = arithmetic.verified(records.filter(~F.coalesce(failed, F.lit(False))), expression="expression")
    named = checked.withColumn("fingerprint", arithmetic.fingerprint(F.col("expression")))
    missing = F.when(F.col("answer").isNull() | F.col("fingerprint").isNull(), "invalid_record")
    return named.select("file", "position", "expression", "fingerprint", F.coalesce("issue", missing).alias("issue"))


def imported(spark: SparkSession, path: str, cache: str, pattern: str = "*") -> Imported:
    """The ledger (fingerprint, file, position, expression: the first record of each calculation by file and
    position), totals by file (added, duplicate, invalid), and how many files there are and were read now.

    A file with an invalid record adds nothing to the ledger until it is mended.
    """
    got = changed_files.refresh(spark, path, cache, lambda paths: _derived(spark, paths), ROWS, pattern)
    sound = F.min(F.col("issue").isNull())
    good = got.rows.join(got.rows.groupBy("file").agg(sound.alias("_sound")).filter("_sound").select("file"), "file", "left_semi")
    first = good.groupBy("fingerprint").agg(F.min(F.struct("file", "position", "expression")).alias("f"))
    ledger = first.select("fingerprint", "f.file", "f.position", "f.expression")
    added = ledger.groupBy("file").agg(F.count("*").alias("added"))
    per = got.rows.groupBy("file").agg(F.count("*").alias("rows"), F.count("issue").alias("invalid")).join(added, "file", "left")
    duplicate = F.when(F.col("invalid") == 0, F.col("rows") - F.coalesce("added", F.lit(0))).otherwise(0)
    totals = per.select("file", F.coalesce("added", F.lit(0)).alias("added"), duplicate.alias("duplicate"), "invalid")
    return Imported(ledger, totals, got.files, got.read)
