"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the folder set by ``SparkContext.setCheckpointDir``.
    A local session (tests) may do without and gets a temporary folder; a cluster may not, because its
    executors would each write to a disk of their own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = found.get() if found.isDefined() else None
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
