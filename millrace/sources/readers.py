"""Readers that turn files into normalised DataFrames.

Only Spark's own readers open files, so any store Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from millrace.operators.storage import stored

TOOL_CALL = "struct<id:string,name:string,input:string>"
MESSAGE = f"struct<role:string,content:string,reasoning_content:string,toolCalls:array<{TOOL_CALL}>,toolCallId:string,toolName:string,isError:boolean>"
ROLLOUT = (
    "attempt int, sessionId string, requestId string, model struct<modelId:string>, "
    f"request struct<messages:array<{MESSAGE}>>, "
    f"response struct<finishReason:string,reasoningText:string,text:string,toolCalls:array<{TOOL_CALL}>,usage:map<string,bigint>>, "
    "error struct<name:string,message:string>"
)


def jsonl(spark: SparkSession, path: str, schema: str, fields: list[str] | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """One row per non-blank line; columns are pruned to ``fields`` in the scan."""
    df = spark.read.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(path)
    return df.select(*fields) if fields else df


def numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """source_name, line (from 1), record (null where malformed), reason.

    Each file is read whole, because its line numbers count blank lines too.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_name"), "value")
    text = F.regexp_replace("value", "^\ufeff", "")
    rows = files.select("source_name", F.posexplode(F.split(text, "\r?\n")).alias("pos", "raw")).filter(F.trim("raw") != "")
    record = F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", schema))
    return rows.select(
        "source_name", (F.col("pos") + 1).alias("line"), record.alias("record"),
        F.when(F.try_parse_json("raw").isNull(), "invalid_json_record").alias("reason"),
    )


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold one JSON array each; anything malformed fails."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def traces(arrays: DataFrame, column: str) -> DataFrame:
    """kind, item: a top-level array of messages alone is one trace, any other is a set of records (JSON texts)."""
    items = F.from_json(column, "array<string>")
    role = lambda x: F.get_json_object(x, "$.role").isNotNull() | F.get_json_object(x, "$.from").isNotNull()
    is_trace = F.forall(items, role) & (F.size(items) > 0)
    one = F.when(is_trace, F.array(F.col(column))).otherwise(items)
    return arrays.select(F.when(is_trace, "trace").otherwise("dataset").alias("kind"), F.explode(one).alias("item"))


def collection_kind(records: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by, kind: conversation_collection where every record has messages, document_collection where every one has text."""
    has = lambda *paths: F.coalesce(*[F.get_json_object(column, f"$.{p}") for p in paths]).isNotNull()
    return records.groupBy(*by).agg(
        F.when(F.bool_and(has("messages", "conversations", "turns")), "conversation_collection")
        .when(F.bool_and(has("text")), "document_collection").alias("kind")
    )


def _decoded(content: bytes) -> tuple[str | None, str | None]:
    """(text, issue): UTF-8, then GB18030, never replacement characters."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return bytes(content).decode(name), None
        except UnicodeDecodeError:
            continue
    return None, "undecodable_text"


def texts(spark: SparkSession, path: str, pattern: str = "*.{md,txt,tex}") -> DataFrame:
    """path, text, issue of text files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [_decoded(c) for c in p["content"]]
            yield pd.DataFrame({"path": p["path"], "text": [x[0] for x in found], "issue": [x[1] for x in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, issue string")


@F.pandas_udf(S.BooleanType())
def _gb18030(lines: pd.Series) -> pd.Series:
    """Whether bytes are sound GB18030; a line end is no part of a longer character there."""

    def sound(b: bytes | None) -> bool:
        try:
            return b is None or bytes(b).decode("gb18030") is not None
        except UnicodeDecodeError:
            return False

    return lines.map(sound)


@F.pandas_udf(S.StringType())
def _from_gb18030(lines: pd.Series) -> pd.Series:
    return lines.map(lambda b: None if b is None else bytes(b).decode("gb18030"))


def text_lines(spark: SparkSession, path: str, pattern: str = "*.{md,txt,tex}") -> DataFrame:
    """path, text, issue of text files line by line: what ``texts`` gives in one row, for files of any size.

    A line keeps its end, and files are read in splits.  The encoding is the whole file's: UTF-8 if all its lines
    are, else GB18030 if all are that, else its one row has the issue alone.  Lines come in no order.
    """
    at = F.col("_metadata")
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    raw = lines.select(
        at["file_path"].alias("path"), at["file_size"].alias("size"), at["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("raw"),
    )
    place = F.struct("block", "row")
    files = stored(raw.groupBy("path", "size").agg(
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"),
        F.sum(F.octet_length("raw") + 1).alias("bytes"), F.min(place).alias("first"), F.max(place).alias("last"),
    ))
    # Of the bytes, the lines lack a byte-order mark (Hadoop's reader drops it) and the end that the last one may not have.
    left = F.col("size") - F.col("bytes")
    files = files.select("path", "utf8", "first", "last", (left >= 2).alias("mark"), left.isin(-1, 2).alias("open"))

    mark = F.when(F.col("mark") & (place == F.col("first")), F.concat(F.lit(b"\xef\xbb\xbf"), "raw")).otherwise(F.col("raw"))
    others = raw.join(files.filter("NOT utf8"), "path")
    other = stored(others.groupBy("path").agg(F.bool_and(_gb18030(mark)).alias("gb18030")))
    known = files.join(other, "path", "left")
    rows = raw.join(known.filter("utf8 OR gb18030"), "path")
    said = F.when(F.col("utf8"), F.col("raw").cast("string")).otherwise(_from_gb18030(F.when(~F.col("utf8"), mark)))
    end = F.when(F.col("open") & (place == F.col("last")), "").otherwise("\n")
    decoded = rows.select("path", F.concat(said, end).alias("text"), F.lit(None).cast("string").alias("issue"))
    refused = known.filter("NOT utf8 AND NOT gb18030").select("path", F.lit(None).cast("string").alias("text"), F.lit("undecodable_text").alias("issue"))
    return decoded.unionByName(refused)


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page, text, issue.  Without the optional reader every file says so."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ModuleNotFoundError:
            PdfReader = None
        for p in parts:
            rows = []
            for name, content in zip(p["path"], p["content"], strict=True):
                if PdfReader is None:
                    rows.append((name, 0, None, "pdf_reader_missing"))
                    continue
                for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    text = page.extract_text() or ""
                    rows.append((name, i, text, None if text.strip() else "requires_vision"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "issue"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, issue string")


def latex_text(source: Column) -> Column:
    """Readable text of LaTeX: comments, commands and environments' names go, their contents stay."""
    out = F.regexp_replace(source, r"(?m)(?<!\\)%.*$", "")
    out = F.regexp_replace(out, r"\\(?:begin|end)\{[^}]*\}", "")
    out = F.regexp_replace(out, r"\\(?:section|subsection|chapter|title)\*?\{([^}]*)\}", "# $1\n")
    out = F.regexp_replace(out, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    return F.trim(F.regexp_replace(out, r"\\[A-Za-z]+\*?", ""))


def latex_issue(source: Column) -> Column:
    return F.when(source.rlike(r"\\(?:input|include|includegraphics|write18)\b"), "external_include")


def rollouts(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, ROLLOUT)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified, category of a workspace's files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.col("path")
    category = (
        F.when(name.rlike(r"/manifest\.json$"), "manifest").when(name.rlike(r"/quality\.json$"), "quality")
        .when(name.rlike(r"\.records\.json$"), "audit").when(name.rlike(r"\.jsonl$"), "training").otherwise("source")
    )
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), category.alias("category"))


def released(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A released corpus, after its manifest (name, rows, sha256) has been verified; order does not matter."""
    from millrace.sources.sinks import digest

    df = spark.read.schema(schema).json(f"{path}/data")
    said = spark.read.json(f"{path}/manifest").first()
    found = digest(df)
    if said is None or (said["rows"], said["sha256"]) != found:
        raise ValueError("the released corpus does not match its manifest")
    return df


def unparsed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (sha256, ...) whose content and parser no cached row covers."""
    return files.join(cache.select("sha256", "parser"), ["sha256", "parser"], "left_anti")
