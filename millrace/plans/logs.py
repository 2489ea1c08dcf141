"""Queries over files and agent logs made from the given tables: readers, packages, rollouts, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import rollouts, trajectories
from millrace.plans.feeds import _folder
from millrace.plans.registry import query, table
from millrace.sources import readers, sinks
from millrace.sources.readers import MESSAGE, TOOL_CALL

# --- files of records --------------------------------------------------------------------------


@query("s1_jsonl_fields", "SELECT doc_id, source FROM documents")
def s1(spark, d):
    """Documents as JSON lines among other files; of their fields two are read."""
    path = _folder(spark, "jsonl")
    table(spark, d, "documents").write.option("compression", "none").json(f"{path}/in")
    lines = spark.read.text(f"{path}/in")
    lines.write.format("text").option("compression", "none").save(f"{path}/other")
    return readers.jsonl(spark, f"{path}/in", "doc_id bigint, text string, source string", ["doc_id", "source"], "*.json")


_LINE = "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id END"


@query(
    "s2_numbered_lines",
    f"""WITH n AS (SELECT doc_id, doc_id % 4 AS shard, sum(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS line FROM documents)
    SELECT shard, line::INT AS line, {_LINE} AS doc_id, CASE WHEN doc_id % 13 = 0 THEN 'invalid_json_record' END AS reason FROM n""",
)
def s2(spark, d):
    """Four files with a byte-order mark, a blank line before every fifth record, and every thirteenth cut off."""
    path = _folder(spark, "numbered")
    docs = table(spark, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(4)).alias("shard"))
    first = docs.groupBy("shard").agg(F.min("doc_id").alias("first"))
    body = F.when(F.col("doc_id") % 13 == 0, '{"doc_id": ').otherwise(F.to_json(F.struct("doc_id", "shard")))
    mark = F.when(F.col("doc_id") == F.col("first"), "﻿").otherwise("")
    # A shuffled join would stand in for the repartitioning below, and its skewed partitions may be split:
    # a shard would then be several files.  ``first`` has four rows.
    rows = docs.join(F.broadcast(first), "shard").withColumn("value", F.concat(mark, F.when(F.col("doc_id") % 5 == 0, "\n").otherwise(""), body))
    rows.repartition("shard").sortWithinPartitions("shard", "doc_id").select("shard", "value").write.partitionBy("shard").text(path)
    found = [readers.numbered_jsonl(spark, f"{path}/shard={n}", "doc_id bigint").withColumn("shard", F.lit(n)) for n in range(4)]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.select(F.col("shard").cast("bigint").alias("shard"), F.col("line").cast("int").alias("line"), "record.doc_id", "reason")


@query(
    "s4_arrays_and_traces",
    """WITH g AS (SELECT conv_id % 3 AS shard, count(DISTINCT conv_id) AS talks, count(*) AS turns FROM conversations GROUP BY 1)
    SELECT shard, CASE shard WHEN 0 THEN 'trace' ELSE 'dataset' END AS kind, CASE shard WHEN 1 THEN 'conversation_collection' WHEN 2 THEN 'document_collection' END AS collection,
    CASE shard WHEN 0 THEN talks ELSE turns END AS items FROM g""",
)
def s4(spark, d):
    """Arrays by conversation: of messages alone, of records with messages, of records with a text."""
    turns = table(spark, d, "conversations")
    kind = F.pmod("conv_id", F.lit(3))
    message = F.to_json(F.struct("role", F.col("text").alias("content")))
    item = F.when(kind == 0, message).when(kind == 1, F.concat(F.lit('{"messages":['), message, F.lit("]}"))).otherwise(F.to_json(F.struct("text")))
    arrays = turns.groupBy("conv_id", kind.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))).alias("x"))
    arrays = arrays.select("shard", F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["i"]), ","), F.lit("]")).alias("body"))
    # The kind of each array is told by its items; records are grouped by where they came from.
    per = [readers.traces(arrays.filter(F.col("shard") == n), "body").withColumn("shard", F.lit(n).cast("bigint")) for n in range(3)]
    every = per[0].unionByName(per[1]).unionByName(per[2])
    kinds = readers.collection_kind(every.filter("kind = 'dataset'"), "item", ["shard"]).withColumnRenamed("kind", "collection")
    return every.groupBy("shard", "kind").agg(F.count("*").alias("items")).join(kinds, "shard", "left").select("shard", "kind", "collection", "items")


@query("s7_text_files", "SELECT doc_id % 5 AS shard, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE sum(length(text) + 1) END::BIGINT AS chars, CASE WHEN doc_id % 5 = 3 THEN 'undecodable_text' END AS issue FROM documents GROUP BY 1, 3, doc_id % 5")
def s7(spark, d):
    """Five text files of documents, one after another; one file ends in bytes of no known encoding."""
    path = _folder(spark, "texts")
    docs = table(spark, d, "documents").select(F.pmod("doc_id", F.lit(5)).alias("shard"), "text")
    rows = docs.repartition("shard").sortWithinPartitions("shard")

    def write(batches):
        import os

        top = path.removeprefix("file://")
        os.makedirs(top, exist_ok=True)
        begun: set[int] = set()  # a task that runs again writes its files anew
        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(f"{top}/{shard}.txt", "ab" if shard in begun else "wb") as out:
                    begun.add(shard)
                    out.write((text + "\n").encode() + (b"\xff\xff" if shard == 3 else b""))
        yield from ()

    rows.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()
    found = readers.text_lines(spark, path, "*.txt").groupBy("path").agg(F.sum(F.length("text")).alias("chars"), F.max("issue").alias("issue"))
    return found.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("shard"), "chars", "issue")


@query("s12_released_corpus", "SELECT doc_id, text FROM documents")
def s12(spark, d):
    """A release is written with its manifest and read back after the manifest was verified."""
    path = _folder(spark, "release")
    docs = table(spark, d, "documents").select("doc_id", "text")
    sinks.release(docs, path, "v1", sinks.digest(docs)[1])
    return readers.released(spark, f"{path}/v1", "doc_id bigint, text string")


@query(
    "e5_package",
    """SELECT 'cpt' AS target, count(*) FILTER (doc_id % 7 <> 0) AS rows, (count(*) FILTER (doc_id % 7 = 0)) AS held_back, 'text' AS fields FROM documents
    UNION ALL SELECT 'gsm8k', count(*) FILTER (p_partkey % 7 <> 0), count(*) FILTER (p_partkey % 7 = 0), 'answer,question' FROM part""",
)
def e5(spark, d):
    """Two targets in one package; every seventh row is quarantined, so it is audited but not delivered."""
    path = _folder(spark, "package")

    def judged(df, key):
        held = F.col(key) % 7 == 0
        return df.withColumns({"status": F.when(held, "quarantined").otherwise("eligible"), "reason": F.when(held, "by_rule")})

    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("answer"))
    sinks.write_package({"cpt": judged(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "gsm8k": judged(parts, "p_partkey")}, path)
    manifest = spark.read.schema("target string, rows bigint").json(f"{path}/manifest")
    quality = [spark.read.schema("status string, n bigint").json(f"{path}/{t}/quality").withColumn("target", F.lit(t)) for t in ("cpt", "gsm8k")]
    held = quality[0].unionByName(quality[1]).filter("status = 'quarantined'").select("target", F.col("n").alias("held_back"))
    data = [spark.read.json(f"{path}/{t}/data") for t in ("cpt", "gsm8k")]
    fields = F.when(F.col("target") == "cpt", ",".join(sorted(data[0].columns))).otherwise(",".join(sorted(data[1].columns)))
    return manifest.join(held, "target").select("target", "rows", "held_back", fields.alias("fields"))


# --- rollout logs ------------------------------------------------------------------------------

# Each answer of a conversation is a record whose request holds the turns before it.  In every fourth conversation a
# calculator was called just before, in every eighth it failed, in every twelfth its result is wrong; in every tenth
# (leaving 3) the call of the model failed; every third turn has reasoning.
LOG = """t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
  r AS (SELECT conv_id, turn, pos, text, conv_id || '-' || turn AS request_id, conv_id % 4 = 0 AS tools, conv_id % 8 = 0 AS failed, conv_id % 10 = 3 AS error,
    CASE WHEN turn % 3 = 0 THEN 'why ' || turn END AS reasoning FROM t WHERE role = 'assistant')"""


def rollout_log(spark, d):
    """The records, written as JSON lines and read as a log."""
    path = _folder(spark, "rollouts")
    none = {k: F.lit(None).cast(v) for k, v in (("reasoning_content", "string"), ("toolCalls", f"array<{TOOL_CALL}>"), ("toolCallId", "string"), ("toolName", "string"), ("isError", "boolean"))}

    def message(role, content, **more):
        parts = {"role": role, "content": content} | none | more
        return F.struct(*(v.alias(k) for k, v in parts.items())).cast(MESSAGE)

    said = F.struct("turn", message(F.col("role"), F.col("text")).alias("m"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("ms"))
    rows = talks.select("conv_id", "ms", F.posexplode("ms").alias("pos", "x")).filter("x.m.role = 'assistant'")
    name = F.concat(F.lit("c"), F.col("pos").cast("string"))
    asked = F.concat(F.lit('{"expression": "2 + '), F.col("pos").cast("string"), F.lit('"}'))
    call = F.array(F.struct(name.alias("id"), F.lit("calculator").alias("name"), asked.alias("input")))
    value = (F.col("pos") + 2 + F.when(F.col("conv_id") % 12 == 0, 1).otherwise(0)).cast("string")
    tools = F.array(
        message(F.lit("assistant"), F.lit(""), toolCalls=call),
        message(F.lit("tool"), value, toolCallId=name, toolName=F.lit("calculator"), isError=F.col("conv_id") % 8 == 0),
    )
    before = F.transform(F.slice("ms", F.lit(1), F.col("pos")), lambda x: x["m"])
    messages = F.when(F.col("conv_id") % 4 == 0, F.concat(before, tools)).otherwise(before)
    turn = F.col("x.turn")
    response = F.struct(
        F.lit("stop").alias("finishReason"), F.when(turn % 3 == 0, F.concat(F.lit(" why "), turn.cast("string"))).alias("reasoningText"),
        F.col("x.m.content").alias("text"), F.array().cast(f"array<{TOOL_CALL}>").alias("toolCalls"),
    )
    failed = F.when(F.col("conv_id") % 10 == 3, F.struct(F.lit("Timeout").alias("name"), F.lit("late").alias("message")))
    log = rows.select(
        F.lit(1).alias("attempt"), F.col("conv_id").cast("string").alias("sessionId"), F.concat_ws("-", "conv_id", turn).alias("requestId"),
        F.struct(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("modelId")).alias("model"),
        F.struct(messages.alias("messages")).alias("request"), response.alias("response"), failed.alias("error"),
    )
    log.write.json(f"{path}/log")
    return readers.jsonl(spark, f"{path}/log", readers.ROLLOUT, pattern="*.json")


@query("s6_rollout_records", f"WITH {LOG} SELECT request_id, CASE WHEN error OR text = '' THEN 'error' ELSE 'ok' END AS status, (pos + CASE WHEN tools THEN 2 ELSE 0 END)::INT AS n_messages, 'm' || conv_id % 3 AS model FROM r")
def s6(spark, d):
    log = rollout_log(spark, d)
    return log.select(F.col("requestId").alias("request_id"), rollouts.status(log).alias("status"), F.size("request.messages").alias("n_messages"), F.col("model.modelId").alias("model"))


@query(
    "v12_rollout_samples",
    f"""WITH {LOG}, ok AS (FROM r WHERE NOT error AND text <> '')
    SELECT request_id, style, CASE WHEN style = 'plain' THEN concat_ws(chr(10), reasoning, trim(text, E' \\n\\t')) ELSE trim(text, E' \\n\\t') END AS content,
    CASE WHEN style = 'separated' THEN reasoning END AS reasoning, CASE WHEN failed THEN 1 ELSE 0 END AS error_tool_steps,
    (pos + 1 + CASE WHEN tools THEN 2 ELSE 0 END)::INT AS n_messages, count(*) OVER (PARTITION BY request_id) = 3 AS same_id
    FROM ok, (SELECT unnest(['separated', 'plain', 'drop']) AS style)""",
)
def v12(spark, d):
    """Samples in three styles; a record's identity does not depend on the style."""
    from millrace.operators.storage import stored

    log = stored(rollout_log(spark, d))
    parts = [rollouts.samples(log, s).withColumn("style", F.lit(s)) for s in ("separated", "plain", "drop")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ids = every.groupBy("request_id", "id").agg(F.count("*").alias("n")).select("request_id", (F.col("n") == 3).alias("same_id"))
    last = F.element_at("messages", -1)
    return every.join(ids, "request_id").select(
        "request_id", "style", last["content"].alias("content"), last["reasoning_content"].alias("reasoning"), "error_tool_steps",
        F.size("messages").alias("n_messages"), "same_id",
    )


@query(
    "v13_rollout_classes",
    f"WITH {LOG} SELECT CASE WHEN failed THEN 'recovery' ELSE 'clean' END AS tag, 'answer' AS finish, reasoning IS NOT NULL AS has_reasoning, count(*) AS n FROM r WHERE NOT error AND text <> '' GROUP BY ALL",
)
def v13(spark, d):
    found = rollouts.classified(rollouts.samples(rollout_log(spark, d)))
    return found.groupBy("tag", "finish", "has_reasoning").agg(F.count("*").alias("n"))


@query(
    "v14_error_pairs",
    f"WITH {LOG} SELECT request_id, pos::INT AS prompt_messages, 'c' || pos AS rejected_call, trim(text, E' \\n\\t') AS chosen FROM r WHERE failed AND NOT error AND text <> ''",
)
def v14(spark, d):
    """Each failed call against the final answer; the prompt ends before the turn that made it."""
    log = rollout_log(spark, d)
    names = log.select(F.col("requestId").alias("request_id"), F.to_json(F.struct(F.col("response.text").alias("t"))).alias("t"))
    pairs = rollouts.error_pairs(log)
    body = F.to_json(F.struct(F.get_json_object("chosen", "$.content").alias("t")))
    call = F.get_json_object("rejected", "$.toolCalls[0].id")
    one = pairs.select(F.json_array_length("prompt").alias("prompt_messages"), call.alias("rejected_call"), F.get_json_object("chosen", "$.content").alias("chosen"), body.alias("t"))
    trimmed = names.withColumn("chosen", F.regexp_replace(F.get_json_object("t", "$.t"), r"^\s+|\s+$", "")).drop("t")
    place = F.concat(F.lit("c"), F.size("request.messages") - 2)
    placed = trimmed.join(log.select(F.col("requestId").alias("request_id"), place.alias("rejected_call")), "request_id")
    return one.drop("t").join(placed, ["chosen", "rejected_call"]).select("request_id", "prompt_messages", "rejected_call", "chosen")


@query(
    "a11_import_report",
    f"WITH {LOG} SELECT count(*) FILTER (NOT error AND text <> '') AS ok, count(*) FILTER (error OR text = '') AS errors, count(*) AS stopped, count(*) FILTER (conv_id % 3 = 1) AS by_m1 FROM r",
)
def a11(spark, d):
    """The reports of all files added up."""
    per = rollouts.import_report(rollout_log(spark, d))
    one = lambda m, k: F.coalesce(F.sum(F.try_element_at(m, F.lit(k))), F.lit(0)).cast("bigint")
    return per.agg(F.sum("ok").cast("bigint").alias("ok"), F.sum("errors").cast("bigint").alias("errors"), one("finish_reasons", "stop").alias("stopped"), one("models", "m1").alias("by_m1"))


@query(
    "v17_replay_of_log",
    f"""WITH {LOG} SELECT request_id AS id, CASE WHEN tools AND conv_id % 12 = 0 THEN 'negative' ELSE 'ok' END AS status,
    CASE WHEN tools AND conv_id % 12 = 0 THEN 'observation_mismatch' END AS reason FROM r""",
)
def v17(spark, d):
    """The calculator's calls are run again."""
    rows = rollout_log(spark, d).select(F.col("requestId").alias("id"), F.to_json("request.messages").alias("messages"), F.lit("{}").alias("snapshots"))
    return trajectories.replay(rows)


@query(
    "d21_pruned_steps",
    f"""WITH {LOG} SELECT request_id AS id, CASE WHEN tools AND conv_id % 16 <> 0 THEN 1 ELSE 0 END AS removed,
    (pos + CASE WHEN NOT tools THEN 0 WHEN conv_id % 16 = 0 THEN 5 ELSE 2 END)::INT AS left_over FROM r""",
)
def d21(spark, d):
    """Each call is made twice, the second time under another id; in every sixteenth conversation a later
    message names that id, so the step stays."""
    log = rollout_log(spark, d).select(F.col("requestId").alias("id"), F.col("sessionId").cast("bigint").alias("conv"), "request.messages")
    size = F.size("messages")
    step = F.slice("messages", F.greatest(size - 1, F.lit(1)), F.lit(2))
    again = F.transform(step, lambda m: m.withField("toolCallId", F.concat(m["toolCallId"], F.lit("again"))).withField(
        "toolCalls", F.transform(m["toolCalls"], lambda c: c.withField("id", F.concat(c["id"], F.lit("again"))))))
    blank = {k: F.lit(None) for k in ("reasoning_content", "toolCalls", "toolCallId", "toolName", "isError")}
    named = F.struct(F.lit("user").alias("role"), F.concat(F.lit("see "), F.get(again, F.lit(1))["toolCallId"]).alias("content"), *(v.alias(k) for k, v in blank.items())).cast(MESSAGE)
    tools = F.col("conv") % 4 == 0
    more = F.when(tools & (F.col("conv") % 16 == 0), F.concat("messages", again, F.array(named))).when(tools, F.concat("messages", again)).otherwise(F.col("messages"))
    rows = log.select("id", F.to_json(more).alias("messages"))
    return trajectories.prune(rows).select("id", F.col("removed").cast("int").alias("removed"), F.json_array_length("messages").alias("left_over"))


@query("e6_trainer_gate", f"WITH {LOG} SELECT request_id AS id, CASE WHEN tools AND conv_id % 16 = 4 THEN 'missing_tool_result' END AS issue FROM r WHERE NOT error AND text <> '' AND pos > 0")
def e6(spark, d):
    """The samples of the log, system turns aside; in every sixteenth conversation the last result is missing."""
    found = rollouts.samples(rollout_log(spark, d)).filter(F.size("messages") > 1)
    missing = (F.col("session_id").cast("bigint") % 16 == 4)
    kept = F.when(missing, F.filter("messages", lambda m: m["role"] != "tool")).otherwise(F.col("messages"))
    return found.select(F.col("request_id").alias("id"), trajectories.trainer_issues(F.to_json(kept)).alias("issue"))


@query(
    "v15_chat_trajectories",
    """WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE text <> ''),
    u AS (SELECT conv_id, min_by(text, turn) AS instruction FROM t WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id::VARCHAR AS task_id, CASE WHEN length(instruction) > 8000 THEN NULL ELSE instruction END AS instruction, (count(*) - 1)::INT AS steps, count(*) FILTER (role = 'user') - 1 AS corrections
    FROM t JOIN u USING (conv_id) GROUP BY conv_id, instruction HAVING count(*) > 1""",
)
def v15(spark, d):
    """Chat logs in which every turn is said twice in a row; the first user turn is the instruction."""
    none = F.lit(None)
    turn = F.struct("role", F.col("text").alias("content"), none.cast("string").alias("name"), none.cast("string").alias("args"), none.cast("struct<ok:boolean,output:string,exit_code:int>").alias("result"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    twice = F.flatten(F.transform("ts", lambda x: F.array(x["t"], x["t"])))
    tasks = talks.select(F.col("conv_id").cast("string").alias("task_id"), F.lit(None).cast("string").alias("instruction"), twice.alias("turns"))
    found = rollouts.chat_trajectories(tasks)
    corrections = F.size(F.filter("traj", lambda s: s["code"].startswith("user_correction("))).cast("bigint")
    return found.select("task_id", "instruction", F.size("traj").alias("steps"), corrections.alias("corrections"))


@query(
    "v8_reasoning_envelopes",
    """WITH t AS (SELECT conv_id, turn, text, turn % 4 AS kind, trim(text, E' \\n\\t') AS said FROM conversations)
    SELECT conv_id, turn, CASE WHEN kind = 0 THEN 'so' END AS reasoning, CASE kind WHEN 0 THEN said WHEN 1 THEN text END AS answer,
    CASE WHEN kind > 1 THEN 'malformed_reasoning_envelope' END AS issue, CASE kind WHEN 1 THEN 'no_thought' WHEN 2 THEN 'no_thought' WHEN 3 THEN 'complete' ELSE 'complete' END AS state FROM t""",
)
def v8(spark, d):
    """Turns with an envelope, without one, with one that is not closed, and with one that is not opened."""
    kind, text = F.col("turn") % 4, F.col("text")
    made = F.when(kind == 0, F.concat(F.lit("<think> so </think>"), text)).when(kind == 1, text).when(kind == 2, F.concat(F.lit("<think>"), text)).otherwise(F.concat(F.lit("so</think>"), text))
    rows = table(spark, d, "conversations").select("conv_id", "turn", rollouts.envelope(made).alias("e"), rollouts.split_thought(made).alias("s"))
    return rows.select("conv_id", "turn", "e.reasoning", "e.answer", "e.issue", "s.state")


@query("v19_edited_messages", "SELECT conv_id, conv_id % 5 NOT IN (1, 2) AS matches FROM conversations GROUP BY conv_id")
def v19(spark, d):
    """Edits that change texts alone match; one that changes a role and one that loses a message do not."""
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))
    case = F.col("conv_id") % 5
    edited = F.transform("ms", lambda m, i: m.withField("text", F.lit("edited")).withField("role", F.when((case == 1) & (i == 0), F.lit("tool")).otherwise(m["role"])))
    after = F.when(case == 2, F.slice(edited, 1, F.greatest(F.size(edited) - 1, F.lit(0)))).otherwise(edited)
    return talks.select("conv_id", rollouts.edits_match(F.col("ms"), after).alias("matches"))
