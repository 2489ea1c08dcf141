"""Keyed ledgers as snapshots: append, merge, current state, production counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def identity(*parts: Column) -> Column:
    """SHA-256 of the JSON array of exact texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def task_identity(task: Column) -> Column:
    """Case kept, white space folded."""
    return T.comparison_text(task)


def planned(tasks: DataFrame, seen: DataFrame, key: str, text: str, limit: int = 512) -> DataFrame:
    """key, issue: the gate, the length, a task of the same batch or an earlier one with the same identity."""
    df = tasks.withColumn("_id", task_identity(F.col(text)))
    first = df.groupBy("_id").agg(F.min(key).alias("_first"))
    old = seen.select(task_identity(F.col(text)).alias("_id")).distinct().withColumn("_old", F.lit(True))
    both = df.join(first, "_id").join(old, "_id", "left")
    again = F.col("_old") | (F.col(key) != F.col("_first"))
    issue = T.text_issue(F.col(text))
    return both.select(
        key, F.when(issue.isNotNull(), issue).when(F.length(text) > limit, "task_too_long").when(again, "duplicate_normalized_task").alias("issue")
    )


def append(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger and those rows whose key it lacks (insert or ignore); equal new keys enter once."""
    fresh = rows.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")
    return ledger.unionByName(fresh.select(ledger.columns))


def votes(ledger: DataFrame, new: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The vote ledger after new votes: stale content is refused, one vote per record and user stays."""
    valid = new.join(records.select(key, "digest"), [key, "digest"], "left_semi")
    return append(ledger, valid, [key, "username"])


def reviewed_release(candidates: DataFrame, decisions: DataFrame, key: str, sequence: str) -> tuple[DataFrame, int]:
    """(approved candidates with their reviewed text, how many are still undecided)."""
    last = decisions.groupBy(key).agg(F.max_by(F.struct("decision", "text"), sequence).alias("d"))
    both = candidates.join(last, key, "left")
    pending = both.filter(F.coalesce("d.decision", F.lit("pending")) == "pending").count()
    return both.filter("d.decision = 'approved'").select(key, "d.text"), pending


def rework(reviews: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """key, n, issue: each review must name exactly one eligible candidate."""
    n = candidates.filter("status = 'eligible'").groupBy(key).agg(F.count("*").alias("n"))
    df = reviews.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return df.select(key, "n", F.when(F.col("n") == 0, "rework_candidate_missing").when(F.col("n") > 1, "rework_candidate_ambiguous").alias("issue"))


def archive_search(chunks: DataFrame, operations: DataFrame, term: str, limit: int) -> DataFrame:
    """operation_id, offset (its first hit), at: newest operations first; the limit is asked for."""
    hits = chunks.filter(F.array_contains(T.search_tokens(F.col("text")), term)).groupBy("operation_id").agg(F.min("offset").alias("offset"))
    return hits.join(operations, "operation_id").select("operation_id", "offset", "at").orderBy(F.desc("at"), "operation_id").limit(limit)


def asset_order(name: Column, origin: Column, mtime: Column, path: Column) -> list[Column]:
    """Sources first, documents first among them, newest outputs first, then names."""
    document = F.lower(name).rlike(r"\.(?:pdf|docx|md|txt|tex|latex)$")
    source = origin == "source"
    return [
        F.when(source, 0).otherwise(1), F.when(source & document, 0).otherwise(1),
        F.when(origin == "output", -mtime).otherwise(0), F.lower(name), F.lower(path),
    ]


def batch_size(missing: Column, round_size: Column, max_attempts: Column, attempted: Column, round_number: Column, max_rounds: Column) -> Column:
    """The next production window: what is missing, bounded by round size and attempts left."""
    stop = (round_number >= max_rounds) | (attempted >= max_attempts)
    return F.when(stop, 0).otherwise(F.least(F.greatest(missing, F.lit(0)), round_size, max_attempts - attempted))


def integrity(rows: DataFrame, key: str) -> DataFrame:
    """key, digest: rows as canonical JSON, to compare a checkpoint with what is read."""
    return rows.select(key, F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("digest"))


def context_packs(units: DataFrame, by: str, order: str, size: str, capacity: int) -> DataFrame:
    """by, order, pack: neighbouring units of a source share a pack of about ``capacity`` bytes.

    Packs follow from a running sum over ranges, so a source of any size is
    spread over many tasks and no group is gathered.
    """
    from millrace.operators.review import running

    placed = running(units.select(by, order, size), by, [order], F.col(size), "_before")
    return placed.select(by, order, F.floor(F.col("_before") / capacity).cast("long").alias("pack"))


def merged_memory(entries: DataFrame, content: list[str], source: str) -> DataFrame:
    """id, content, sources, entries: entries of one content are one, with all their sources in the order of
    their digests; contents that differ in anything stay apart.  Null sources are left out.

    Sources are reduced to distinct ones before they meet, so a content that very many entries share is no
    gathered group of them.
    """
    named = entries.withColumn("id", identity(*(F.to_json(F.struct(F.col(c).alias("x"))) for c in content)))
    distinct = named.groupBy("id", *content, source).agg(F.count("*").alias("_n"))
    told = F.when(F.col(source).isNotNull(), F.struct(F.sha2(F.col(source).cast("string"), 256).alias("d"), F.col(source).alias("s")))
    per = distinct.groupBy("id", *content).agg(F.array_sort(F.collect_list(told)).alias("_s"), F.sum("_n").alias("entries"))
    return per.select("id", *content, F.transform("_s", lambda x: x["s"]).alias("sources"), "entries")
