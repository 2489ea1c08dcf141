"""Claims and their evidence: review windows, half comparisons, evidence by identity, human issues, supervision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.review import latest

# Limits of a review window, phrases of a half comparison, source-wide absence, hedges, denials.
MAX_UNITS, MAX_CHARS = 12, 2400
HALF = r"不到一半|少于一半|超过一半|多于一半|至少一半|至多一半|\b(?:less|more) than half\b|\bat (?:least|most) half\b"
ABSENCE = (
    r"(?i)(?:论文|研究|作者|全文).{0,20}(?:没有|未曾|未)(?:给出|报告|提供|进行|做)|"
    r"\b(?:paper|study|authors?)\b.{0,40}\b(?:does not|did not|never|no)\b"
)
PERCENT = r"(?<![\d.])([0-9]+(?:\.[0-9]+)?)\s*[%％]"
DIRECT = rf"(?i)[0-9]+(?:\.[0-9]+)?\s*[%％]\s*[，,]?\s*(?:即|也就是|which is\s+)?(?:{HALF})[。.!;；]?\s*$"
HEDGED = (
    r"(?i)[“”\x22「」]|假如|如果|并非|不是|不能说|声称|说法|约|近似|"
    r"\b(?:if|not|incorrect|wrong|says?|claims?|about|roughly|approximately)\b"
)
DENIAL = r"(?i)^(?:It is (?:wrong|incorrect) to say|不能说|错误说法是)\s*[\x22“][^\x22”]+[\x22”][。.]*$"


def review_windows(units: DataFrame, by: str, order: str, text: str, most: int = MAX_UNITS, chars: int = MAX_CHARS) -> DataFrame:
    """by, order, window: the units of each request in runs of ``most`` units and ``chars`` characters at most.

    A longer unit has a window of its own; null texts have no length.  Where a
    run ends depends on all runs before, so a request's lengths (not its texts)
    are folded in order, one small array a request.
    """
    row = F.struct(F.col(order).alias("at"), F.coalesce(F.length(text), F.lit(0)).alias("n"))
    start = F.struct(
        F.lit(0).alias("window"), F.lit(0).alias("units"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<int>").alias("all")
    )

    def step(acc: Column, unit: Column) -> Column:
        full = (acc["units"] > 0) & ((acc["units"] >= most) | (acc["chars"] + unit["n"] > chars))
        window = acc["window"] + F.when(full, 1).otherwise(0)
        return F.struct(
            window.alias("window"), (F.when(full, 0).otherwise(acc["units"]) + 1).alias("units"),
            (F.when(full, F.lit(0).cast("long")).otherwise(acc["chars"]) + unit["n"]).alias("chars"), F.concat(acc["all"], F.array(window)).alias("all"),
        )

    per = units.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("_units"))
    placed = per.withColumn("_windows", F.aggregate("_units", start, step, lambda acc: acc["all"]))
    return placed.select(by, F.explode(F.arrays_zip("_units", "_windows")).alias("u")).select(
        by, F.col("u._units.at").alias(order), F.col("u._windows").alias("window")
    )


def halves(ids: Column) -> Column:
    """A window's ids as two, the first of which is the shorter; null for a window that cannot be divided."""
    middle = F.floor(F.size(ids) / 2).cast("int")
    return F.when(F.size(ids) >= 2, F.array(F.slice(ids, 1, middle), F.slice(ids, middle + 1, F.size(ids) - middle)))


def half_comparison(quote: Column, stance: Column, claim_status: Column) -> Column:
    """struct<status,issue> of a quote that compares with one half or denies for a whole source; null for any other.

    Only one percentage right before one half phrase is decided, exactly: twice
    the whole part, and one more for a fraction that is not zero, against 100.
    """
    said = F.regexp_extract_all(quote, F.lit(f"(?i){HALF}"), F.lit(0))
    absent, count = quote.rlike(ABSENCE), F.size(said)
    values = F.regexp_extract_all(quote, F.lit(PERCENT), F.lit(1))
    value, phrase = F.get(values, F.lit(0)), F.lower(F.get(said, F.lit(0)))
    whole = F.regexp_replace(F.substring_index(value, ".", 1), "^0+", "")
    twice = F.when(F.length(whole) > 2, 200).otherwise(F.concat(F.lit("0"), whole).cast("int") * 2) + value.rlike(r"\.[0-9]*[1-9]").cast("int")
    holds = (
        F.when(phrase.isin("不到一半", "少于一半", "less than half"), twice < 100)
        .when(phrase.isin("超过一半", "多于一半", "more than half"), twice > 100)
        .when(phrase.isin("至少一半", "at least half"), twice >= 100)
        .otherwise(twice <= 100)
    )
    out = lambda status, issue=None: F.struct(F.lit(status).alias("status"), F.lit(issue).cast("string").alias("issue"))
    clear = (F.size(values) == 1) & (count == 1) & quote.rlike(DIRECT) & ~quote.rlike(HEDGED)
    return (
        F.when(quote.isNull() | ((count == 0) & ~absent), None)
        .when(
            stance.isin("negated", "quoted", "non_propositional"),
            F.when(quote.rlike(DENIAL) & (claim_status == "not_claim"), out("verified")).otherwise(out("unresolved", "assertion_stance_needs_evidence")),
        )
        .when(absent, out("unresolved", "source_wide_absence_not_established"))
        .when(~clear, out("unresolved", "comparison_reference_unresolved"))
        .when(holds, out("verified"))
        .otherwise(out("violated", "comparison_value_conflict"))
    )


def with_evidence(candidates: DataFrame, records: DataFrame, key: str, payload: Column, order: str, evidence: str) -> DataFrame:
    """``candidates`` with evidence: that of the first eligible record whose payload's SHA-256 is their key, else {}."""
    mine = records.filter("status = 'eligible'").select(F.sha2(payload, 256).alias(key), order, evidence)
    first = mine.groupBy(key).agg(F.min_by(evidence, order).alias("evidence"))
    return candidates.join(first, key, "left").withColumn("evidence", F.coalesce("evidence", F.lit("{}")))


def issue_store(rows: DataFrame, keys: list[str], order: str, content: list[str]) -> DataFrame:
    """``rows`` that a store of human issues holds, with superseded_by: the next one of the same candidate.

    A row that repeats the live issue of its candidate does not enter, and each
    one that enters replaces the live one.  The live one is always the row
    before, or equal to it, so one look back decides.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_is", F.sha2(F.to_json(F.struct(*content)), 256)).withColumn("_was", F.lag("_is").over(w))
    kept = marked.filter(F.col("_was").isNull() | (F.col("_was") != F.col("_is"))).drop("_is", "_was")
    return kept.withColumn("superseded_by", F.lead(order).over(w))


def next_issues(store: DataFrame, events: DataFrame, key: str, sequence: str, at: str, limit: int) -> DataFrame:
    """The next ``limit`` live issues to work on: pending before needs_revision, oldest first.

    ``events`` are changes of status (key, sequence, status); an issue without one is pending.
    """
    live = store.filter("superseded_by IS NULL").join(latest(events.select(key, sequence, "status"), key, sequence).drop(sequence), key, "left")
    open_ = live.withColumn("status", F.coalesce("status", F.lit("pending"))).filter(F.col("status").isin("pending", "needs_revision"))
    return open_.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), at, key).limit(limit)


def supervision(ids: Column, labels: Column, mask: Column, eos: int, trailing: tuple[int, ...] = ()) -> Column:
    """struct<issue,prompt_tokens,supervised_tokens,eos_position> of a training example.

    A label of -100 is masked.  The prompt (one token at least) is masked, all
    after it is supervised by its own ids, and after the last end marker only
    ``trailing`` ids follow.  Positions count from 0; they are null beside an issue.
    """
    n, size = F.coalesce(F.size(ids), F.lit(0)), lambda c: F.coalesce(F.size(c), F.lit(0))
    first = F.array_position(F.transform(labels, lambda x: x != -100), F.lit(True)).cast("int")
    last = (n - F.array_position(F.reverse(labels), F.lit(eos))).cast("int")
    rest = lambda c, at: F.slice(c, F.greatest(at, F.lit(1)), n)
    unaligned = (n == 0) | (n != size(labels)) | (n != size(mask))
    incomplete = (
        (first < 2) | (last >= n) | F.array_contains(rest(labels, first), -100) | (rest(ids, first) != rest(labels, first))
        | F.exists(rest(ids, last + 2), lambda x: ~x.isin(*trailing) if trailing else F.lit(True))
    )
    issue = F.when(unaligned, "training_validation_invalid_token_alignment").when(
        F.coalesce(incomplete, F.lit(True)), "training_validation_incomplete_supervision"
    )
    ok = lambda c: F.when(issue.isNull(), c)
    return F.struct(
        issue.alias("issue"), ok(first - 1).alias("prompt_tokens"), ok(n - first + 1).alias("supervised_tokens"), ok(last).alias("eos_position")
    )
