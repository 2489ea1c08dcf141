"""Distribution, retention and release statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def source_summary(judged: DataFrame, exact: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per source from rows with source, norm_chars and reason and their exact duplicates."""
    df = judged.join(exact, key)
    status = F.when(F.col("reason").isNotNull(), "quarantined").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("exported")
    out = F.col("status") == "exported"
    return df.withColumn("status", status).groupBy("source").agg(
        F.count("*").alias("candidates"), _count(out).alias("exported"), _count(F.col("status") == "duplicate").alias("duplicates"),
        _count(F.col("status") == "quarantined").alias("quarantined"),
        F.coalesce(F.sum(F.when(out, F.col("norm_chars"))), F.lit(0)).cast("long").alias("exported_chars"),
        (_count(out) / F.count("*")).alias("retention_rate"),
    )


def funnel(judged: DataFrame, exact: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: how many rows each step keeps, and the rates."""
    passed = F.col("reason").isNull()
    out = passed & F.col("duplicate_of").isNull()
    n, p, e = F.count("*"), _count(passed), _count(out)
    return judged.join(exact, key).agg(
        n.alias("parsed"), p.alias("quality_passed"), e.alias("exported"), F.try_divide(p, n).alias("quality_rate"),
        F.try_divide(e, p).alias("dedup_rate"), F.try_divide(e, n).alias("overall_rate"),
    )


def conversation_features(turns: DataFrame) -> DataFrame:
    """conv_id, body_chars, user_chars, user_turns, target_chars, language of every conversation."""
    role = F.col("role")
    chars = lambda r: F.coalesce(F.sum(F.when(role == r, F.length("text"))), F.lit(0)).cast("long")
    han = F.sum(F.regexp_count("text", F.lit(T.HAN)))
    latin = F.sum(F.regexp_count("text", F.lit("[A-Za-z]")))
    share = F.try_divide(han, han + latin)
    language = F.when(share.isNull(), "other").when(share.between(0.2, 0.8), "mixed").when(share > 0.8, "zh").otherwise("en")
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("body_chars"), chars("user").alias("user_chars"),
        _count(role == "user").alias("user_turns"), chars("assistant").alias("target_chars"), language.alias("language"),
    )


def histogram(df: DataFrame, bins: Column, every: list[str]) -> DataFrame:
    """bin, n, with zero rows for bins that do not occur."""
    spark = df.sparkSession
    names = spark.createDataFrame([(b,) for b in every], "bin string")
    return names.join(df.groupBy(bins.alias("bin")).agg(F.count("*").alias("n")), "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def coverage(rows: DataFrame, dimensions: list[str], limit: int = 12) -> DataFrame:
    """dimension, value, accepted: the most frequent values of each dimension, by count and then by value."""
    from millrace.operators.search import top

    said = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    counts = rows.select(F.explode(said).alias("d")).select("d.*").filter("value IS NOT NULL").groupBy("dimension", "value").agg(F.count("*").alias("accepted"))
    return top(counts, "dimension", "value", "accepted", limit).select("dimension", "value", "accepted")


def rewards(rows: DataFrame, reward: str) -> DataFrame:
    """count, correct, accuracy (null of no rows) of rewards of 0 or 1; anything else is an error."""
    bad = F.raise_error(F.lit("reward is neither 0 nor 1")).cast("int")
    value = F.when(F.col(reward).isin(0, 1), F.col(reward)).otherwise(bad)
    return rows.select(value.alias("r")).agg(F.count("r").alias("count"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("correct"), F.avg("r").alias("accuracy"))


def shard_audit(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, rows, empty, chars, longest of a corpus; of its columns these alone are read."""
    n = F.length(text)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("empty"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.max(n).alias("longest")
    )


def input_summary(units: DataFrame, status: str, max_units: int, *by: str) -> DataFrame:
    """by, units, ready, quarantined, skipped, deferred: ready units beyond ``max_units`` wait for a later run."""
    n = lambda s: F.count_if(F.coalesce(F.col(status) == s, F.lit(False)))
    found = units.groupBy(*by).agg(F.count("*").alias("units"), n("ready").alias("ready"), n("quarantined").alias("quarantined"), n("skipped").alias("skipped"))
    return found.withColumn("deferred", F.greatest(F.lit(0), F.col("ready") - max_units))


def production_state(receipts: DataFrame, goals: dict[str, int]) -> DataFrame:
    """target, goal, eligible, attempted, remaining, rounds for each goal (a small table of settings), also for
    those without a receipt (target, round, eligible, attempted)."""
    known = receipts.filter(F.col("target").isin(*goals)).groupBy("target").agg(
        F.sum("eligible").cast("bigint").alias("eligible"), F.sum("attempted").cast("bigint").alias("attempted"), F.count_distinct("round").alias("rounds")
    )
    wanted = receipts.sparkSession.createDataFrame(list(goals.items()), "target string, goal bigint")
    n = lambda c: F.coalesce(c, F.lit(0))
    return wanted.join(known, "target", "left").select(
        "target", "goal", n("eligible").alias("eligible"), n("attempted").alias("attempted"),
        F.greatest(F.lit(0), F.col("goal") - n("eligible")).alias("remaining"), n("rounds").alias("rounds"),
    )
