"""One text to many rows: chunks, windows and line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import udfs


def structure(docs: DataFrame, key: str = "doc_id", text: str = "text", legacy: bool = False) -> DataFrame:
    """key, pos, chunk."""
    found = paragraphs(F.col(text)) if legacy else udfs.chunks(F.col(text))
    return docs.select(key, F.posexplode(found).alias("pos", "chunk"))


def paragraphs(text: Column, target: int = 2000, overlap: int = 0) -> Column:
    """array of chunks: paragraphs packed up to ``target`` characters by a fold.  A heading starts a
    chunk, and a longer paragraph is cut into equal strides."""
    parts = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: x.rlike(r"(?U)\S")), lambda x: F.regexp_replace(x, r"\n+$", ""))
    stride = target - min(max(0, overlap), target - 1)

    def cut(p: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(p) - target) / stride).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(p, i * stride + 1, F.lit(target)))

    def state(done: Column, held: Column, size: Column, last: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), size.alias("size"), last.alias("last"))

    none, zero = F.lit(""), F.lit(0)

    def step(acc: Column, p: Column) -> Column:
        closed = F.when(acc["size"] > 0, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        new = (acc["size"] > 0) & (F.ltrim(p).startswith("#") | (acc["size"] + F.length(p) > target))
        tail = F.right(acc["last"], F.lit(overlap)) if overlap > 0 else none
        begun = F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        grown = F.when(acc["size"] > 0, F.concat(acc["held"], F.lit("\n\n"), p)).otherwise(p)
        return (
            F.when(F.length(p) > target, state(F.concat(closed, cut(p)), none, zero, none))
            .when(new, state(closed, begun, F.length(tail) + F.length(p), p))
            .otherwise(state(acc["done"], grown, acc["size"] + F.length(p), p))
        )

    start = state(F.array().cast("array<string>"), none, zero, none)
    return F.aggregate(parts, start, step, lambda a: F.when(a["size"] > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))


def index_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2000) -> DataFrame:
    """key, pos, chunk for a search index: structure chunks, each cut into slices of ``size``."""
    rows = structure(docs, key, text)
    starts = F.sequence(F.lit(0), F.length("chunk") - 1, F.lit(size))
    rows = rows.select(key, "pos", "chunk", F.posexplode(starts).alias("part", "start"))
    slice_ = F.substr("chunk", F.col("start") + 1, F.lit(size))
    return rows.select(key, "pos", "part", slice_.alias("chunk"))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", stride: int = 1000, width: int = 1400) -> DataFrame:
    """key, start, passage: overlapping windows; starts count from 0."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride)))
    rows = docs.select(key, F.col(text), F.explode(starts).alias("start"))
    return rows.select(key, "start", F.substr(F.col(text), F.col("start") + 1, F.lit(width)).alias("passage"))


def corpus(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``chunks`` without those whose text an earlier one has, white space aside."""
    named = chunks.withColumn("chunk_id", T.chunk_id(F.col("chunk"))).withColumn("_at", F.struct(key, "pos"))
    first = named.groupBy("chunk_id").agg(F.min("_at").alias("_first"))
    return named.join(first, "chunk_id").filter("_at = _first").drop("_at", "_first")


def oversized(chunk: Column, target: int = 2000) -> Column:
    return F.length(chunk) > max(12_000, 4 * target)


def numbered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), content."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "content")).select(
        key, (F.col("pos") + 1).alias("line"), "content"
    )


def line_ranges(docs: DataFrame, ranges: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first, last, passage of inclusive line ranges: a slice of the row's lines, no range join."""
    rows = docs.select(key, F.split(text, "\n").alias("_lines")).join(ranges, key)
    ok = (F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.size("_lines"))
    cut = F.array_join(F.slice("_lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    return rows.select(key, "first", "last", F.when(ok, cut).alias("passage"))


def claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, quote, claim_id: sentences that hold a digit or a word of strength."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*\s*|[.!?\n]\s*"), F.lit(0))
    numbered = docs.select(key, text).withColumn("_row", F.monotonically_increasing_id())
    pieces = numbered.select("_row", key, F.posexplode(parts).alias("_at", "part"))
    before = Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)).cast("int")
    rows = pieces.select(key, start.alias("start"), F.rtrim("part").alias("quote"))
    kept = rows.filter(F.col("quote").rlike(r"(?i)[0-9]|\b(?:always|never|all|none|every|only|must)\b"))
    name = F.concat_ws(":", F.lit(text), F.col("start").cast("string"), "quote")
    return kept.withColumn("claim_id", F.substring(F.sha2(name, 256), 1, 16))
