"""Queries over files and feeds made from the given tables: huge JSON, growing event files, reordering, rounds."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.storage import shared_folder, stored
from millrace.plans.corpus import PACKAGED
from millrace.plans.registry import query, table
from millrace.sources import huge_json
from millrace.streaming import byte_feed, incremental, reorder, rounds


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- huge JSON objects -------------------------------------------------------------------------


def written_json(docs, path: str, array: bool = False) -> None:
    """Eight files of one JSON object each (shard, records); those of shard 5 whose id leaves 5 by 40
    repeat a key inside a record.  Or eight files of one sound array each."""
    shard = F.pmod(F.col("doc_id"), F.lit(8)).alias("shard")
    about = F.concat(F.lit('{"lang":'), F.to_json(F.array("lang")), F.lit(',"source":'), F.to_json(F.array("source")))
    again = F.when((F.pmod(F.col("doc_id"), F.lit(40)) == 5) & ~F.lit(array), F.lit(',"lang":[]')).otherwise("")
    body = F.to_json(F.struct("doc_id", "text"))
    line = F.concat(F.lit(","), F.expr("substring(_body, 1, length(_body) - 1)"), F.lit(',"about":'), about, again, F.lit("}}"))
    records = docs.withColumn("_body", body).select(shard, F.lit(1).alias("part"), "doc_id", line.alias("value"))
    ends = docs.sparkSession.range(8).select(
        F.col("id").alias("shard"), F.explode(F.lit([0, 2])).alias("part"), F.lit(0).cast("bigint").alias("doc_id")
    )
    top = F.lit("[") if array else F.concat(F.lit('{"shard":'), F.col("shard").cast("string"), F.lit(',"records":['))
    head = F.concat(top, F.lit('{"doc_id":-1}'))
    ends = ends.select("shard", "part", "doc_id", F.when(F.col("part") == 0, head).otherwise("]" if array else "]}").alias("value"))
    every = records.unionByName(ends).repartition(8, "shard").sortWithinPartitions("shard", "part", "doc_id")
    every.select("shard", "value").write.partitionBy("shard").text(path)


@query(
    "s5_huge_json",
    """WITH n AS (SELECT doc_id % 8 AS shard, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS place FROM documents),
    bad AS (SELECT shard, min(place) AS place FROM n WHERE doc_id % 40 = 5 GROUP BY shard)
    SELECT shard, CASE WHEN bad.place IS NULL THEN count(*) ELSE 0 END AS records, CASE WHEN bad.place IS NULL THEN sum(chars) ELSE 0 END::BIGINT AS chars,
    CASE WHEN bad.place IS NULL THEN NULL ELSE 'duplicate_key' END AS issue, '/records/' || bad.place || '/about/lang' AS pointer
    FROM n LEFT JOIN bad USING (shard) GROUP BY shard, bad.place""",
)
def s5(spark, d):
    path = _folder(spark, "huge-json")
    written_json(table(spark, d, "documents"), path)
    rows = huge_json.huge_json(spark, path)
    shard = F.regexp_extract("file", r"shard=(\d+)", 1).cast("bigint")
    record = F.from_json("value", "doc_id bigint, text string")
    whole = huge_json.accepted(rows.filter(F.col("pointer").startswith("/records/") | F.col("issue").isNotNull()))
    found = whole.withColumn("r", record).filter("r.doc_id >= 0").groupBy(shard.alias("shard")).agg(
        F.count("*").alias("records"), F.sum(F.length("r.text")).alias("chars")
    )
    refused = rows.filter(F.col("issue").isNotNull()).select(shard.alias("shard"), "issue", "pointer")
    both = found.join(refused, "shard", "full_outer")
    return both.select("shard", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("chars", F.lit(0)).alias("chars"), "issue", "pointer")


@query("s3_records_one_by_one", "SELECT doc_id, length(text) AS chars, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS place FROM documents")
def s3(spark, d):
    """The records of arrays, read one after another; each knows its place."""
    path = _folder(spark, "arrays")
    written_json(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), path, array=True)
    record = F.from_json("value", "doc_id bigint, text string").alias("r")
    rows = huge_json.accepted(huge_json.huge_json(spark, path, depth=1)).select("place", record).filter("r.doc_id >= 0")
    return rows.select("r.doc_id", F.length("r.text").cast("bigint").alias("chars"), "place")


# --- a growing event file ----------------------------------------------------------------------

#: Events of one feed in the play below, at most.
FEED_EVENTS = 2_000


def grown(events, folder: str, share: float, begun: float = 0.0) -> None:
    """Writes the bytes of each feed (``FEED_EVENTS`` events by number) between two shares of its length.
    The bytes go to their own place in the file, so a task that runs again changes nothing."""

    def run(feed: pa.Table) -> pa.Table:
        import os

        lines = feed.sort_by("event_id")["line"].to_pylist()
        body = "".join(x + "\n" for x in lines).encode()
        begin, end = int(len(body) * begun), int(len(body) * share)
        top = folder.removeprefix("file://")
        os.makedirs(top, exist_ok=True)
        with open(os.open(f"{top}/{feed['feed'][0]}.jsonl", os.O_CREAT | os.O_WRONLY), "wb") as out:
            out.seek(begin)
            out.write(body[begin:end])
        return pa.table({"feed": feed["feed"][:1]})

    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    feeds = events.select(F.expr(f"event_id div {FEED_EVENTS}").alias("feed"), "event_id", line.alias("line"))
    feeds.groupBy("feed").applyInArrow(run, "feed bigint").write.format("noop").mode("overwrite").save()


@query("r3_byte_feed", "SELECT event_id, user_id, event_type, value, 1::BIGINT AS times FROM events")
def r3(spark, d):
    """The feeds are read when half written, in the midst of records, then from the cursor when whole."""
    events = table(spark, d, "events")
    folder, out, checkpoint = (_folder(spark, f"feed-{x}") for x in ("in", "out", "state"))
    for begun, share in ((0.0, 0.37), (0.37, 0.81), (0.81, 1.0)):
        grown(events, folder, share, begun)
        incremental.run_available(byte_feed.byte_feed(spark, folder), out, checkpoint)
    event = F.from_json("event", "event_id bigint, user_id bigint, event_type string, value double").alias("e")
    read = spark.read.schema("file string, position bigint, next_position bigint, event string").parquet(out)
    return read.select(event).groupBy("e.event_id", "e.user_id", "e.event_type", "e.value").agg(F.count("*").alias("times"))


# --- concurrent results in order ---------------------------------------------------------------


@query(
    "r5_stage_order",
    """WITH n AS (SELECT event_type AS stage, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS item FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY event_id) - 1 AS position FROM n WHERE item % 7 <> 3)
    SELECT stage, item, 0::BIGINT AS row, event_id::VARCHAR AS payload, position FROM k""",
)
def r5(spark, d):
    """Events are items by their place within their type; they arrive in five shuffled files, and every
    seventh has no rows."""
    at = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    items = table(spark, d, "events").select(F.col("event_type").alias("stage"), "event_id", at.cast("bigint").alias("item"))
    none = F.array().cast("array<string>")
    items = stored(items.withColumn("payloads", F.when(F.pmod("item", F.lit(7)) == 3, none).otherwise(F.array(F.col("event_id").cast("string")))))
    arrived, out, checkpoint = (_folder(spark, f"stage-{x}") for x in ("in", "out", "state"))
    for n in range(5):
        mine = items.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == n).select("stage", "item", "payloads")
        mine.repartition(1, F.lit(n)).write.mode("append").parquet(arrived)
    schema = "stage string, item bigint, payloads array<string>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    kept = spark.conf.get(reorder.STORE[0])
    spark.conf.set(*reorder.STORE)
    try:
        incremental.run_available(reorder.in_order(stream), out, checkpoint)
    finally:
        spark.conf.set(reorder.STORE[0], kept)
    return spark.read.schema(reorder.OUT).parquet(out).select("stage", "item", "row", "payload", "position")


# --- deduplication in rounds -------------------------------------------------------------------


@query("r6_dedup_rounds", f"WITH {PACKAGED} SELECT * FROM packaged")
def r6(spark, d):
    """Three rounds over thirds of the documents, by id: what one run over all of them gives."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    folder = _folder(spark, "rounds")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    for n in range(3):
        rounds.dedup_round(docs.filter((F.col("doc_id") > last * n // 3 - (n == 0)) & (F.col("doc_id") <= last * (n + 1) // 3)), folder)
    return rounds.results(spark, folder)
