"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are texts, which cost far more to work on than to move.
TEXTS = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table.  A text table of fewer splits than the cluster has cores (a small file of one
    row group) is dealt anew, so that all cores work on it; larger ones are read as they lie."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df
