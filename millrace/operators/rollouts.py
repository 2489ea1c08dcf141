"""Agent logs to samples: status, assembly, classification, pairs, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.readers import MESSAGE

NO_CALLS = "array<struct<id:string,name:string,input:string>>"


def _text(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit("")))


def _calls() -> Column:
    return F.coalesce("response.toolCalls", F.array().cast(NO_CALLS))


def status(records: DataFrame) -> Column:
    """error where the call failed or said nothing, else ok."""
    silent = (F.coalesce("response.text", F.lit("")) == "") & (F.size(_calls()) == 0)
    return F.when(F.col("error").isNotNull() | silent, "error").otherwise("ok")


def final_message(style: str = "separated", marks: tuple[str, str] = ("", "")) -> Column:
    """The response as an assistant message: reasoning separated, in tags, plain or dropped."""
    reasoning, text = _text(F.col("response.reasoningText")), _text(F.col("response.text"))
    shown = F.when(reasoning != "", F.concat(F.lit(marks[0]), reasoning, F.lit(marks[1])) if style == "tags" else reasoning)
    content = text if style in ("separated", "drop") else F.concat_ws("\n", shown, F.nullif(text, F.lit("")))
    kept = F.when(F.lit(style == "separated") & (reasoning != ""), reasoning)
    none = F.lit(None)
    return F.struct(
        F.lit("assistant").alias("role"), content.alias("content"), kept.alias("reasoning_content"), _calls().alias("toolCalls"),
        none.cast("string").alias("toolCallId"), none.cast("string").alias("toolName"), none.cast("boolean").alias("isError"),
    ).cast(MESSAGE)


def record_id() -> Column:
    """An identity that does not depend on the reasoning style."""
    said = [F.coalesce(c, F.lit("")) for c in ("requestId", "response.reasoningText", "response.text")]
    return F.concat(F.lit("rollout-"), F.substring(F.sha2(F.concat_ws("\x1f", *said, F.to_json(_calls())), 256), 1, 16))


def samples(records: DataFrame, style: str = "separated", marks: tuple[str, str] = ("", ""), max_messages: int = 0) -> DataFrame:
    """id, session_id, request_id, model, finish_reason, error_tool_steps, messages of successful records."""
    known = F.filter("request.messages", lambda m: m["role"].isin("user", "assistant", "tool", "system"))
    history = F.coalesce(known, F.array().cast(f"array<{MESSAGE}>"))
    if max_messages:
        history = F.slice(history, F.greatest(F.size(history) - max_messages + 1, F.lit(1)), F.lit(max_messages))
    df = records.filter(status(records) == "ok").withColumn("_h", history)
    return df.select(
        record_id().alias("id"), F.col("sessionId").alias("session_id"), F.col("requestId").alias("request_id"),
        F.col("model.modelId").alias("model"), F.col("response.finishReason").alias("finish_reason"),
        F.size(F.filter("_h", lambda m: F.coalesce(m["isError"], F.lit(False)))).alias("error_tool_steps"),
        F.concat("_h", F.array(final_message(style, marks))).alias("messages"),
    )


def classified(rows: DataFrame) -> DataFrame:
    """id, tag, finish, n_messages, has_reasoning."""
    last = F.element_at("messages", -1)
    return rows.select(
        "id", F.when(F.col("error_tool_steps") > 0, "recovery").otherwise("clean").alias("tag"),
        F.when(F.size(last["toolCalls"]) > 0, "tool-calls").otherwise("answer").alias("finish"),
        F.size("messages").alias("n_messages"), (F.coalesce(last["reasoning_content"], F.lit("")) != "").alias("has_reasoning"),
    )


def error_pairs(records: DataFrame) -> DataFrame:
    """prompt, rejected, chosen (JSON): each failed call, the turn that made it, and the final response.

    The latest earlier assistant with the same call id is found inside the
    record's own array.
    """
    df = records.filter(status(records) == "ok").withColumn("m", F.col("request.messages"))
    rows = df.select("m", final_message().alias("chosen"), F.posexplode("m").alias("i", "e"))
    failed = rows.filter((F.col("e.role") == "tool") & F.col("e.isError"))

    def calls(x: Column, i: Column) -> Column:
        same = F.exists(F.coalesce(x["toolCalls"], F.array().cast(NO_CALLS)), lambda c: c["id"] == F.col("e.toolCallId"))
        return F.when((x["role"] == "assistant") & (i < F.col("i")) & same, i)

    at = F.array_max(F.transform("m", calls))
    found = failed.withColumn("at", at).filter("at IS NOT NULL")
    return found.select(
        F.to_json(F.slice("m", F.lit(1), F.col("at"))).alias("prompt"),
        F.to_json(F.get("m", F.col("at"))).alias("rejected"), F.to_json("chosen").alias("chosen"),
    ).distinct()


def import_report(records: DataFrame) -> DataFrame:
    """One row per file: ok, errors, finish reasons and models as maps."""
    named = records.withColumns({"file": F.col("_metadata.file_name"), "status": status(records), "finish": F.col("response.finishReason"), "model_id": F.col("model.modelId")})
    parts = named.groupBy("file", "status", "finish", "model_id").agg(F.count("*").alias("n"))
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(c, F.lit("")), "n"))))
    base = parts.groupBy("file").agg(
        F.sum(F.when(F.col("status") == "ok", F.col("n")).otherwise(0)).alias("ok"),
        F.sum(F.when(F.col("status") == "error", F.col("n")).otherwise(0)).alias("errors"),
    )
    for c, name in (("finish", "finish_reasons"), ("model_id", "models")):
        base = base.join(parts.groupBy("file", c).agg(F.sum("n").alias("n")).groupBy("file").agg(entry(F.col(c)).alias(name)), "file")
    return base


def chat_trajectories(tasks: DataFrame) -> DataFrame:
    """task_id, instruction, traj (array<struct<code,ok,error_hint>>) of chat logs with
    turns array<struct<role,content,name,args,result:struct<ok,output,exit_code>>>."""
    said = F.filter("turns", lambda t: (F.coalesce(t["content"], F.lit("")) != "") | (t["role"] == "tool"))
    df = tasks.withColumn("_s", said)
    # Adjacent equal turns count once.
    df = df.withColumn("_t", F.filter("_s", lambda t, i: (i == 0) | ~t.eqNullSafe(F.get("_s", i - 1))))
    users = F.filter("_t", lambda t: t["role"] == "user")
    given = F.nullif(F.coalesce("instruction", F.lit("")), F.lit(""))
    df = df.withColumns({"_given": given, "_first": F.coalesce(F.array_position(F.transform("_t", lambda t: t["role"]), "user"), F.lit(0))})
    text = T.truncated(F.coalesce("_given", F.get(users, F.lit(0))["content"], F.lit("")))

    def step(t: Column) -> Column:
        quoted = lambda c: F.regexp_extract(F.to_json(F.struct(T.truncated(F.coalesce(c, F.lit(""))).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
        bad = F.coalesce(t["result"]["exit_code"] != 0, F.lit(False)) | F.coalesce(~t["result"]["ok"], F.lit(False))
        code = (
            F.when(t["role"] == "user", F.concat(F.lit("user_correction("), quoted(t["content"]), F.lit(")")))
            .when(t["role"] == "tool", F.concat(F.coalesce(t["name"], F.lit("call_tool")), F.lit("("), F.coalesce(t["args"], F.lit("{}")), F.lit(")")))
            .otherwise(F.concat(F.lit("assistant_answer("), quoted(t["content"]), F.lit(")")))
        )
        tool = t["role"] == "tool"
        return F.struct(
            code.alias("code"), F.when(tool, ~bad).alias("ok"), F.when(tool & bad, F.substring(t["result"]["output"], 1, 500)).alias("error_hint")
        )

    rest = F.filter("_t", lambda t, i: F.col("_given").isNotNull() | (i + 1 != F.col("_first")))
    out = df.withColumn("_text", text).select(
        F.coalesce(F.nullif("task_id", F.lit("")), F.substring(F.sha2("_text", 256), 1, 16)).alias("task_id"),
        F.col("_text").alias("instruction"), F.transform(rest, step).alias("traj"),
    )
    return out.filter(F.size("traj") > 0)


def gui_samples(records: DataFrame) -> DataFrame:
    """task_id, messages, task_completed of GUI trajectories; a step's result is the next step's observation."""
    task = F.coalesce(F.nullif("instruction", F.lit("")), "natural_language_task", F.lit(""))
    blank = F.lit(None).cast("string")

    def pair(s: Column, i: Column) -> Column:
        v = s["value"]
        why = F.concat_ws("\n", *[F.nullif(F.coalesce(v[k], F.lit("")), F.lit("")) for k in ("observation", "thought", "reflection")])
        name = F.concat(F.lit("gui_"), F.coalesce(s["index"], i).cast("string"))
        act = F.struct(F.lit("assistant").alias("role"), F.trim(F.coalesce(v["instruction"], F.lit(""))).alias("content"), why.alias("reasoning_content"), v["code"].alias("code"), name.alias("call_id"))
        after = F.get("traj", i + 1)
        seen = F.struct(F.lit("tool").alias("role"), F.coalesce(after["value"]["observation"], F.lit("")).alias("content"), blank.alias("reasoning_content"), blank.alias("code"), name.alias("call_id"))
        return F.when(after.isNotNull(), F.array(act, seen)).otherwise(F.array(act))

    ask = F.struct(F.lit("user").alias("role"), task.alias("content"), blank.alias("reasoning_content"), blank.alias("code"), blank.alias("call_id"))
    return records.filter("task_completed").select(
        "task_id", F.concat(F.array(ask), F.flatten(F.transform("traj", pair))).alias("messages"), "task_completed"
    )


def envelope(text: Column) -> Column:
    """struct<reasoning,answer,issue> of <think>...</think>answer."""
    n = F.regexp_count(text, F.lit("<think>"))
    shut = F.regexp_count(text, F.lit("</think>"))
    ok = (n == 1) & (shut == 1) & text.rlike(r"(?s)^\s*<think>.*?</think>")
    return F.struct(
        F.when(ok, T.strip(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))).alias("reasoning"),
        F.when(ok, T.strip(F.regexp_extract(text, r"(?s)</think>(.*)$", 1))).otherwise(F.when(n + shut == 0, text)).alias("answer"),
        F.when(~ok & (n + shut > 0), "malformed_reasoning_envelope").alias("issue"),
    )


def split_thought(text: Column) -> Column:
    """struct<thought,answer,state>: cut at the first closing tag."""
    at = F.locate("</think>", text)
    thought = F.regexp_replace(F.substr(text, F.lit(1), at - 1), r"^\s*<think>", "")
    return F.struct(
        F.when(at > 0, thought).alias("thought"), F.when(at > 0, F.substr(text, at + 8)).otherwise(text).alias("answer"),
        F.when(at == 0, "no_thought").when(T.strip(F.substr(text, at + 8)) == "", "thought_only").otherwise("complete").alias("state"),
    )


def edits_match(before: Column, after: Column) -> Column:
    """Whether an edited message array keeps length and roles."""
    return (F.size(before) == F.size(after)) & F.forall(F.zip_with(before, after, lambda a, b: a["role"].eqNullSafe(b["role"])), lambda x: x)
