"""Preference pairs, their evidence and trainer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, GAP = 4, 2


def best_and_worst(candidates: DataFrame, prompt: str, answer: str, score: str, order: str) -> DataFrame:
    """prompt, chosen, rejected, chosen_score, rejected_score per prompt: best at least HIGH, gap at
    least GAP, texts different.  Two reductions, no sorting of a prompt's candidates."""
    best = F.max_by(F.struct(order, answer, score), F.struct(score, (-F.col(order)).alias("o"))).alias("b")
    worst = F.min_by(F.struct(order, answer, score), F.struct(score, order)).alias("w")
    df = candidates.groupBy(prompt).agg(best, worst)
    ok = (F.col(f"b.{score}") >= HIGH) & (F.col(f"b.{score}") - F.col(f"w.{score}") >= GAP)
    return df.filter(ok & (F.trim(f"b.{answer}") != F.trim(f"w.{answer}"))).select(
        prompt, F.col(f"b.{order}").alias("chosen"), F.col(f"w.{order}").alias("rejected"),
        F.col(f"b.{score}").alias("chosen_score"), F.col(f"w.{score}").alias("rejected_score"),
    )


def evidence(chosen_score: Column, rejected_score: Column, accepted: Column) -> Column:
    """Why a pair has no evidence, or null."""
    return (
        F.when(~accepted, "chosen_not_accepted")
        .when(chosen_score.isNull() | rejected_score.isNull(), "missing_score")
        .when(chosen_score == rejected_score, "equal_scores")
        .when(chosen_score < HIGH, "chosen_score_below_minimum")
        .when(chosen_score - rejected_score < GAP, "score_gap_below_minimum")
    )


def pair_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def same_answer(a: Column, b: Column) -> Column:
    squeeze = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return squeeze(a) == squeeze(b)


def rlaif(candidates: DataFrame, prompt: str, order: str, score: str) -> DataFrame:
    """prompt, preference_rank, key, score: responses ranked by score, earliest first among equals."""
    from millrace.operators.review import running

    placed = running(candidates.select(prompt, order, score), prompt, [f"-{score}", order], F.lit(1), "_at")
    return placed.select(prompt, (F.col("_at") + 1).cast("int").alias("preference_rank"), order, score)


def style_pairs(messages: DataFrame, rewrites: DataFrame, threshold: int = HIGH) -> DataFrame:
    """id, sample, position, prompt (the texts of earlier user turns, in order), chosen, rejected.

    ``messages``: sample, position, role, content, score.  ``rewrites``: sample, position, round, content,
    score.  Rounds run until one reaches the threshold; a message that has it already is left alone.  The
    best rewrite (the earliest of equals) that beats the message's own score and differs is chosen.
    """
    own = messages.filter((F.col("role") == "assistant") & (F.col("score") < threshold)).select("sample", "position", F.col("content").alias("rejected"), F.col("score").alias("base"))
    done = rewrites.filter(F.col("score") >= threshold).groupBy("sample", "position").agg(F.min("round").alias("last"))
    heard = rewrites.join(done, ["sample", "position"], "left").filter(F.col("last").isNull() | (F.col("round") <= F.col("last")))
    best = heard.groupBy("sample", "position").agg(F.max_by(F.struct("content", "score"), F.struct("score", (-F.col("round")).alias("r"))).alias("b"))
    pairs = own.join(best, ["sample", "position"]).filter((F.col("b.score") > F.col("base")) & (F.col("b.content") != F.col("rejected")))
    asked = messages.filter("role = 'user'").select("sample", F.col("position").alias("at"), F.col("content").alias("said"))
    before = pairs.select("sample", "position").join(asked, "sample").filter(F.col("at") < F.col("position"))
    prompt = before.groupBy("sample", "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]).alias("prompt"))
    out = pairs.join(prompt, ["sample", "position"], "left")
    name = F.concat(F.lit("style-"), F.substring(F.sha2(F.col("b.content"), 256), 1, 16))
    return out.select(name.alias("id"), "sample", "position", F.coalesce("prompt", F.array().cast("array<string>")).alias("prompt"), F.col("b.content").alias("chosen"), "rejected")
