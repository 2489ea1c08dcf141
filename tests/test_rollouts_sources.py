import json

from pyspark.sql import functions as F

from millrace.operators import rollouts
from millrace.sources import readers, sinks
from millrace.streaming import incremental


def record(n, **more):
    base = {
        "attempt": 1, "sessionId": "s", "requestId": f"r{n}", "model": {"modelId": "m"},
        "request": {"messages": [{"role": "user", "content": "q"}]},
        "response": {"finishReason": "stop", "reasoningText": " why ", "text": " yes ", "toolCalls": []},
    }
    return base | more


def failing():
    messages = [
        {"role": "user", "content": "do it"},
        {"role": "assistant", "content": "", "toolCalls": [{"id": "c1", "name": "run", "input": "{}"}]},
        {"role": "tool", "content": "boom", "toolCallId": "c1", "isError": True},
    ]
    return record(3, request={"messages": messages})


def write(path, rows):
    path.mkdir(exist_ok=True)
    (path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_rollout_samples_and_classes(spark, tmp_path):
    rows = [record(1), record(2, error={"name": "x", "message": "y"}), failing()]
    records = readers.rollouts(spark, write(tmp_path / "in", rows))
    assert [r[0] for r in records.orderBy("requestId").select(rollouts.status(records)).collect()] == ["ok", "error", "ok"]
    s = rollouts.samples(records)
    got = {r.request_id: r for r in s.collect()}
    assert got["r1"].messages[-1].content == "yes" and got["r1"].messages[-1].reasoning_content == "why"
    assert got["r3"].error_tool_steps == 1
    tags = {(r.tag, r.finish) for r in rollouts.classified(s).collect()}
    assert tags == {("clean", "answer"), ("recovery", "answer")}
    plain = {r.request_id: r for r in rollouts.samples(records, "plain").collect()}
    assert plain["r1"].messages[-1].content == "why\nyes" and plain["r1"].id == got["r1"].id
    tagged = rollouts.samples(records, "tags", ("<t>", "</t>")).filter("request_id = 'r1'").first()
    assert tagged.messages[-1].content == "<t>why</t>\nyes"
    pairs = rollouts.error_pairs(records).collect()
    assert len(pairs) == 1 and json.loads(pairs[0].prompt)[-1]["role"] == "user" and "c1" in pairs[0].rejected
    report = rollouts.import_report(records).first()
    assert (report.ok, report.errors) == (2, 1) and report.models == {"m": 3}


def test_chat_trajectories(spark):
    schema = (
        "task_id string, instruction string, turns array<struct<role:string,content:string,name:string,args:string,"
        "result:struct<ok:boolean,output:string,exit_code:int>>>"
    )
    user = ("user", "go", None, None, None)
    turns = [user, user, ("tool", None, "ls", '{"a": 1}', (False, "bad", 2)), ("user", "no", None, None, None), ("assistant", "ok", None, None, None)]
    df = spark.createDataFrame([(None, None, turns), ("t", "given", turns)], schema)
    rows = {r.instruction: r for r in rollouts.chat_trajectories(df).collect()}
    assert [s.code for s in rows["go"].traj] == ['ls({"a": 1})', 'user_correction("no")', 'assistant_answer("ok")']
    assert rows["go"].traj[0].ok is False and rows["go"].traj[0].error_hint == "bad"
    assert len(rows["given"].traj) == 4 and rows["given"].task_id == "t"


def test_envelopes(spark):
    df = spark.createDataFrame([("<think> a </think> b",), ("<think>a",), ("plain",)], "t string")
    rows = df.select(rollouts.envelope(F.col("t")).alias("e"), rollouts.split_thought(F.col("t")).alias("s")).collect()
    assert (rows[0].e.reasoning, rows[0].e.answer, rows[0].s.thought) == ("a", "b", " a ")
    assert rows[1].e.issue == "malformed_reasoning_envelope" and rows[2].e.answer == "plain"


def test_jsonl_lines_and_manifest(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text('﻿{"id": "1"}\n\nnot json\n{"id": "2"}')
    rows = readers.numbered_jsonl(spark, str(tmp_path / "x"), "id string").orderBy("line").collect()
    assert [(r.line, r.reason) for r in rows] == [(1, None), (3, "invalid_json_record"), (4, None)]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "text string, n int")
    sinks.release(df, str(tmp_path / "rel"), "v1", sinks.digest(df)[1])
    back = readers.released(spark, str(tmp_path / "rel" / "v1"), "text string, n int")
    assert back.count() == 2 and sinks.digest(df.repartition(3)) == sinks.digest(df)
    sinks.write_package({"cpt": df.withColumns({"status": F.lit("eligible"), "reason": F.lit(None).cast("string")})}, str(tmp_path / "pkg"))
    assert spark.read.json(str(tmp_path / "pkg/cpt/data")).columns == ["text"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes("中文".encode("gb18030"))
    got = {r.path[-4:]: r.text for r in readers.texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "héllo", "b.txt".rjust(4)[-4:]: "中文"} or set(got.values()) == {"héllo", "中文"}


def test_streaming_import_is_incremental(spark, tmp_path):
    source, out, manifest, point = (str(tmp_path / x) for x in ("src", "out", "manifest", "cp"))
    spark.createDataFrame([], "id string").write.parquet(manifest + "/round=-1")
    write(tmp_path / "src", [{"id": "a"}, {"id": "b"}, {"id": "a"}])
    incremental.append_unseen(incremental.files(spark, source, "id string"), manifest, out, "id", point)
    (tmp_path / "src" / "b.jsonl").write_text('{"id": "b"}\n{"id": "c"}\n')
    incremental.append_unseen(incremental.files(spark, source, "id string"), manifest, out, "id", point)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    assert sorted(r.id for r in rows.collect()) == ["a", "b", "c"]


def test_stream_dedup_table(spark, tmp_path):
    write(tmp_path / "src", [{"id": "a"}, {"id": "a"}, {"id": "b"}])
    stream = incremental.new_records(incremental.files(spark, str(tmp_path / "src"), "id string"), "id")
    incremental.run_available(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
