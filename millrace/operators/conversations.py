"""Conversation structure: validation, turns, windows, examples and exports.

A conversation table has one row per turn (conv_id, turn, role, text); arrays of
messages are gathered per conversation, which is one output row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def messages(turns: DataFrame) -> DataFrame:
    """conv_id, messages: array<struct<turn,role,text>> in order."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with user_turn (how many user rows so far) and previous_role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumns(
        {
            "user_turn": F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w),
            "previous_role": F.lag("role").over(w),
        }
    )


def message_windows(turns: DataFrame, size: int = 8) -> DataFrame:
    """conv_id, window, first_turn, last_turn, messages: runs of ``size`` dialogue groups."""
    group = F.floor(F.greatest(F.col("user_turn") - 1, F.lit(0)) / size)
    return numbered(turns).groupBy("conv_id", group.alias("window")).agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("messages")
    )


def _first_issue(msgs: Column) -> Column:
    """The reason of the first message that has one."""

    def one(m: Column) -> Column:
        body = F.coalesce(m["text"], F.lit(""))
        return (
            F.when(m["role"].isNull() | ~m["role"].isin("system", "user", "assistant", "tool"), "invalid_role")
            .when((body != "") & T.text_issue(body).isNotNull(), T.text_issue(body))
            .when(m["role"] == "tool", "orphan_tool_result")
            .when(T.strip(body) == "", "empty_message")
        )

    return F.get(F.filter(F.transform(msgs, one), lambda r: r.isNotNull()), F.lit(0))


def issues(turns: DataFrame, final: bool = True) -> DataFrame:
    """conv_id, issue of plain-text conversations: per-message reasons in order, then whole-conversation ones."""
    df = messages(turns).withColumn("_first", _first_issue(F.col("messages")))
    last = F.element_at("messages", -1)
    unfinished = F.lit(final) & ((last["role"] != "assistant") | (T.strip(F.coalesce(last["text"], F.lit(""))) == ""))
    return df.select(
        "conv_id",
        F.when(F.col("_first").isNotNull(), F.col("_first"))
        .when(~F.exists("messages", lambda m: m["role"] == "user"), "missing_user")
        .when(unfinished, "missing_final_answer")
        .alias("issue"),
    )


def completed_turns(turns: DataFrame, minimum: int = 2) -> DataFrame:
    """conv_id, completed, issue: user turns answered by exactly one assistant message each."""
    plain = turns.filter("role <> 'system'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    seq = plain.withColumn("prev", F.lag("role").over(w))
    marks = seq.withColumn(
        "bad",
        F.when((F.col("role") == "user") & (F.col("prev") == "user"), "unanswered_user_turn")
        .when((F.col("role") == "assistant") & (F.col("prev").isNull() | (F.col("prev") != "user")), "assistant_without_user_turn"),
    )
    per = marks.groupBy("conv_id").agg(
        F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("turn"))).alias("bad"),
        F.min(F.when(F.col("bad").isNotNull(), F.col("turn"))).alias("bad_at"),
        F.max_by("role", "turn").alias("last"), F.count(F.when(F.col("role") == "assistant", 1)).alias("ends"),
        F.min("turn").alias("start"),
    )
    late = turns.filter("role = 'system'").groupBy("conv_id").agg(F.max("turn").alias("system_at"))
    # The first system row after the start, to compare with the first other fault.
    after = turns.filter("role = 'system'").join(per.select("conv_id", "start"), "conv_id").filter("turn > start")
    early = after.groupBy("conv_id").agg(F.min("turn").alias("placed"))
    df = issues(turns).withColumnRenamed("issue", "first_issue").join(per, "conv_id", "left").join(early, "conv_id", "left").join(late, "conv_id", "left")
    misplaced = F.col("placed").isNotNull() & (F.col("bad_at").isNull() | (F.col("placed") < F.col("bad_at")))
    issue = (
        F.when(F.col("first_issue").isNotNull(), F.col("first_issue"))
        .when(misplaced, "system_message_out_of_place")
        .when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("last") != "assistant", "unanswered_user_turn")
        .when(F.col("ends") < minimum, "insufficient_completed_turns")
    )
    return df.select("conv_id", F.when(issue.isNull(), F.col("ends")).otherwise(0).alias("completed"), issue.alias("issue"))


def to_sharegpt(turns: DataFrame) -> DataFrame:
    """conv_id, system, conversations (JSON): system texts merged, roles renamed; none without output."""
    named = F.create_map(*[F.lit(x) for kv in {"user": "human", "assistant": "gpt", "tool": "observation"}.items() for x in kv])
    kept = lambda m: (m["role"] != "system") & ((m["role"] != "assistant") | (m["text"] != ""))
    said = F.transform(F.filter("messages", kept), lambda m: F.struct(named[m["role"]].alias("from"), m["text"].alias("value")))
    system = F.array_join(F.transform(F.filter("messages", lambda m: (m["role"] == "system") & (m["text"] != "")), lambda m: m["text"]), "\n\n")
    df = messages(turns).select("conv_id", F.nullif(system, F.lit("")).alias("system"), said.alias("said"))
    return df.filter(F.exists("said", lambda c: c["from"] == "gpt")).select("conv_id", "system", F.to_json("said").alias("conversations"))


def to_chat(turns: DataFrame) -> DataFrame:
    """conv_id, messages (JSON) of conversations with an assistant message."""
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    df = messages(turns).filter(F.exists("messages", lambda m: m["role"] == "assistant"))
    return df.select("conv_id", F.to_json(plain).alias("messages"))


def per_turn_examples(turns: DataFrame) -> DataFrame:
    """conv_id, turn, history (messages before), target: one example for each assistant message.

    History lengths come from a running count, so no message array is copied for each example.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    df = turns.withColumns(
        {"history": F.count("*").over(w), "history_chars": F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))}
    )
    return df.filter("role = 'assistant'").select("conv_id", "turn", "history", "history_chars", F.length("text").alias("target_chars"))


def dpo_from_errors(steps: DataFrame, by: str, order: str, call: str, failed: Column) -> DataFrame:
    """by, error_at, call, bad_at: each failed step with the latest earlier step of the same call.

    A backward as-of join by a running maximum over (by, call), so no pair is formed.
    """
    w = Window.partitionBy(by, call).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = steps.withColumns({"_failed": failed, "bad_at": F.max(F.when(~failed, F.col(order))).over(w)})
    return df.filter(F.col("_failed") & F.col("bad_at").isNotNull()).select(by, F.col(order).alias("error_at"), call, "bad_at")


def source_issues(turns: DataFrame, limit: int = 80_000) -> DataFrame:
    """conv_id, issue of recorded source conversations: too long a context in place of the structure's
    issues; a secret or personal data anywhere in the messages of one that is not comes before them."""
    plain = F.transform("messages", lambda m: F.struct(F.coalesce(m["text"], F.lit("")).alias("content"), m["role"].alias("role")))
    whole = messages(turns).select("conv_id", F.to_json(plain).alias("_json"))
    gate = T.text_issue(F.col("_json"))
    leak = F.when(gate.isin("potential_secret", "potential_personal_data"), gate)
    both = whole.join(issues(turns), "conv_id")
    long = F.length("_json") > limit
    return both.select("conv_id", F.when(long, "context_exceeds_auto_limit").otherwise(F.coalesce(leak, "issue")).alias("issue"))


def preview(turns: DataFrame) -> DataFrame:
    """conv_id, preview: the conversation as a person reads it; assistant messages without text are left out."""

    def line(m: Column) -> Column:
        body = F.coalesce(m["text"], F.lit(""))
        return (
            F.when(m["role"] == "assistant", F.when(body != "", F.concat(F.lit("【回答】"), body)))
            .when(m["role"] == "tool", F.concat(F.lit("【工具结果✔】"), body))
            .otherwise(F.concat(F.lit("【"), F.coalesce(m["role"], F.lit("")), F.lit("】"), body))
        )

    return messages(turns).select("conv_id", F.array_join(F.transform("messages", line), "\n\n").alias("preview"))
