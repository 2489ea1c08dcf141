"""Incremental imports as Structured Streaming over file sources.

Each function returns a streaming DataFrame or runs what is available and ends;
checkpoints live under the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def files(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """JSON files as they arrive, ``max_files`` in a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def new_records(stream: DataFrame, key: str, at: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first record of each key.  With an event time, state older than the delay is dropped."""
    if at is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to a Parquet table, exactly once, and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_unseen(stream: DataFrame, manifest: str, out: str, key: str, checkpoint: str) -> None:
    """Import rounds against a manifest table: a micro-batch writes only records no earlier round has.

    The batch number names the folders, so a repeated batch overwrites its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema(f"{key} string").option("recursiveFileLookup", "true").parquet(manifest)
        known = known.filter(~F.col("_metadata.file_path").contains(f"/round={number}/"))
        fresh = df.dropDuplicates([key]).join(known.select(key), key, "left_anti").persist()
        fresh.write.mode("overwrite").parquet(f"{out}/round={number}")
        fresh.select(F.col(key).cast("string")).write.mode("overwrite").parquet(f"{manifest}/round={number}")
        fresh.unpersist()

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def audit(stream: DataFrame, by: str, text: str) -> DataFrame:
    """Running counts and lengths by group (complete mode)."""
    n = F.length(text)
    return stream.groupBy(by).agg(F.count("*").alias("rows"), F.sum(n).alias("chars"), F.min(n).alias("least"), F.max(n).alias("most"))


def shard_receipts(stream: DataFrame, text: str, out: str, checkpoint: str) -> None:
    """Watches a directory: each file that has come since the last call leaves one receipt (file, rows, chars,
    blank rows) in the Parquet table ``out``.  A repeated batch overwrites its own receipts."""
    n = F.length(text)
    named = stream.select(F.col("_metadata.file_path").alias("file"), text)

    def batch(df: DataFrame, number: int) -> None:
        per = df.groupBy("file").agg(
            F.count("*").alias("rows"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"),
            F.count(F.when(F.coalesce(F.trim(text), F.lit("")) == "", 1)).alias("blank"),
        )
        per.write.mode("overwrite").parquet(f"{out}/round={number}")

    query = named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def event_windows(events: DataFrame, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Tumbling counts by event type; late rows within the delay still count.  Works on batches and streams."""
    timed = events.withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of users: runs of events with gaps below ``gap``."""
    timed = events.withWatermark("ts", delay)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )
