"""What was derived from files, kept by their signatures, so that a file is read again only if it changed.

A signature is a file's size and time of change.  A run lists the files (their
contents stay unread), reads those of unknown signature, writes what ``derive``
makes of them, and then the signatures: the commit.  A run that broke off leaves
rows that no signature names.  A changed file's new rows replace its old ones,
and a file that is gone takes its rows with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.storage import stored

SIGNATURES = "file string, bytes bigint, modified timestamp, run string"


class Refreshed(NamedTuple):
    rows: DataFrame
    files: int
    read: int


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, bytes, modified of the files under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    at = F.col("_metadata")
    return files.select(at["file_path"].alias("file"), at["file_size"].alias("bytes"), at["file_modification_time"].alias("modified"))


def known(spark: SparkSession, cache: str) -> DataFrame:
    """The signatures of all committed runs."""
    try:
        return spark.read.schema(SIGNATURES).option("recursiveFileLookup", "true").parquet(f"{cache}/files")
    except AnalysisException:
        return spark.createDataFrame([], SIGNATURES)


def refresh(spark: SparkSession, path: str, cache: str, derive: Callable[[list[str]], DataFrame], schema: str, pattern: str = "*") -> Refreshed:
    """The derived rows (``schema``, with a column ``file``) of the files now under ``path``, how many files
    there are, and how many of them were read in this run.

    ``derive`` gets the paths to read.  Files that change while they are read are an error: nothing is committed.
    """
    signature = ["file", "bytes", "modified"]
    now = stored(inventory(spark, path, pattern))
    fresh = stored(now.join(known(spark, cache), signature, "left_anti"))
    paths = [r.file for r in fresh.select("file").collect()]  # names alone, of new files
    if paths:
        run = uuid.uuid4().hex
        derive(paths).write.parquet(f"{cache}/rows/run={run}")
        if not fresh.join(inventory(spark, path, pattern), signature, "left_anti").isEmpty():
            raise ValueError("source_changed_while_read")
        fresh.withColumn("run", F.lit(run)).coalesce(1).write.parquet(f"{cache}/files/{run}")
    # Runs at the same time may have read one file twice: either's rows will do, but not both.
    current = known(spark, cache).join(now, signature).groupBy("file").agg(F.min("run").alias("run"))
    if current.isEmpty():
        return Refreshed(spark.createDataFrame([], schema), now.count(), 0)
    rows = spark.read.schema(f"{schema}, run string").option("basePath", f"{cache}/rows").parquet(f"{cache}/rows")
    return Refreshed(rows.join(current, ["file", "run"]).drop("run"), now.count(), len(paths))
