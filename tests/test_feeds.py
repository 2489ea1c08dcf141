"""Huge JSON, byte feeds, reordering and rounds."""

import io
import json
import random
import tracemalloc

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.sources import huge_json
from millrace.streaming import byte_feed, incremental, reorder, rounds


def read(text, depth=2, chunk=3, most=10**6):
    return list(huge_json.values(io.StringIO(text).read, depth, most, chunk))


def test_values_at_a_depth():
    text = '{"a": 1, "records": [{"x": [1, {"y": "q,\\"}"}]}, 2, []], "e": {}, "b": {"c~/": null}}'
    assert read(text) == [("/a", "1"), ("/records/0", '{"x":[1,{"y":"q,\\"}"}]}'), ("/records/1", "2"), ("/records/2", "[]"), ("/b/c~0~1", "null")]
    assert read("[1,[2]]", 1) == [("/0", "1"), ("/1", "[2]")] and read(" 7 ", 0) == [("", "7")] and read("{}") == []


@pytest.mark.parametrize(
    "text,issue,pointer",
    [
        ('{"a":1,"a":2}', "duplicate_key", "/a"), ('{"r":[{"k":{"z":1,"y":[],"z":2}}]}', "duplicate_key", "/r/0/k/z"),
        ("[1,]", "invalid_json", "/1"), ('{"a":1,}', "invalid_json", "/a"), ("[1]]", "invalid_json", ""), ("[NaN]", "invalid_json", "/0"),
        ('["a', "invalid_json", ""), ("", "invalid_json", ""), ("[1}", "invalid_json", "/0"), ('["' + "x" * 99 + '"]', "value_too_large", "/0"),
    ],
)
def test_refused_texts(text, issue, pointer):
    with pytest.raises(huge_json.Refused) as e:
        read(text, most=50 if issue == "value_too_large" else 10**6)
    assert e.value.issue == issue and e.value.pointer in (pointer, "")


def test_values_equal_a_whole_parse():
    rng = random.Random(0)

    def some(d):
        k = rng.random()
        if d and k < 0.35:
            return {f"k{i}": some(d - 1) for i in range(rng.randrange(4))}
        if d and k < 0.7:
            return [some(d - 1) for _ in range(rng.randrange(4))]
        return rng.choice([1, -2.5e3, True, None, 'x\\"y', "é{[,:", " "])

    def flat(v, depth, at=""):
        if isinstance(v, (dict, list)) and depth:
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                yield from flat(x, depth - 1, f"{at}/{k}")
        else:
            yield at, v

    for _ in range(500):
        v, depth = some(4), rng.randrange(4)
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert [(p, json.loads(x)) for p, x in read(text, depth, rng.choice([1, 2, 7, 100]))] == list(flat(v, depth))


def test_memory_does_not_grow_with_the_file():
    class Endless:
        """A file of n records that is never held whole."""

        def __init__(self, n):
            self.left, self.n, self.rest = n, n, '{"records":['

        def read(self, size):
            while len(self.rest) < size and self.left:
                self.left -= 1
                self.rest += json.dumps({"id": self.left, "text": "x" * 500}) + ("," if self.left else "]}")
            out, self.rest = self.rest[:size], self.rest[size:]
            return out

    peaks = []
    for n in (500, 5000):
        tracemalloc.start()
        assert sum(1 for _ in huge_json.values(Endless(n).read)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 2_000_000


def test_files_are_refused_by_path(spark, tmp_path):
    (tmp_path / "good.json").write_text('﻿{"records": [{"id": 1}, {"id": 2}]}', "utf-8")
    (tmp_path / "bad.json").write_text('{"records": [{"id": 1}, {"id": 2, "in": {"k": 1, "k": 1}}]}')
    (tmp_path / "bytes.json").write_bytes(b'["\xff"]')
    rows = huge_json.huge_json(spark, str(tmp_path))
    issues = {r.file.rsplit("/", 1)[1]: (r.issue, r.pointer) for r in rows.filter("issue IS NOT NULL").collect()}
    assert issues == {"bad.json": ("duplicate_key", "/records/1/in/k"), "bytes.json": ("invalid_encoding", "")}
    assert [(r.pointer, r.value) for r in huge_json.accepted(rows).orderBy("place").collect()] == [("/records/0", '{"id":1}'), ("/records/1", '{"id":2}')]


# --- byte feed ---------------------------------------------------------------------------------


def drained(spark, path, out, state):
    incremental.run_available(byte_feed.byte_feed(spark, path), out, state)
    return sorted(r.event for r in spark.read.parquet(out).collect())


def test_a_feed_cut_anywhere_loses_and_repeats_nothing(spark, tmp_path):
    feed = tmp_path / "in"
    feed.mkdir()
    lines = [json.dumps({"n": i, "t": "é" * (i % 50)}, ensure_ascii=False) for i in range(300)]
    body = "".join(x + "\n" for x in lines).encode()
    args = spark, str(feed), str(tmp_path / "out"), str(tmp_path / "state")
    for cut in (1, 5000, 5001, len(body) - 1, len(body)):
        (feed / "a.jsonl").write_bytes(body[:cut])
        got = drained(*args)
        assert got == sorted(lines[: body[:cut].count(b"\n")])
    (feed / "b.jsonl").write_bytes(b'{"late": 1}\n{"half')
    assert drained(*args) == sorted([*lines, '{"late": 1}'])
    (feed / "a.jsonl").write_bytes(body[:100])
    with pytest.raises(StreamingQueryException, match="invalid_event_cursor"):
        drained(*args)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_own_the_lines_that_begin_in_them(monkeypatch, tmp_path, size):
    monkeypatch.setattr(byte_feed, "RANGE_BYTES", size)
    lines = [json.dumps({"n": "x" * (i % 40)}) for i in range(60)]
    (tmp_path / "f.jsonl").write_text("".join(x + "\n" for x in lines) + '{"open')
    reader = byte_feed.ByteFeedReader(str(tmp_path))
    end = reader.latestOffset()
    got = [row for p in reader.partitions({}, end) for row in reader.read(p)]
    assert [r[3] for r in got] == lines and [r[1] for r in got[1:]] == [r[2] for r in got[:-1]]


@pytest.mark.parametrize("body,issue", [(b"[1]\n", "invalid_control_event"), (b'{"a":"' + b"x" * 70_000 + b'"}\n', "too_large"), (b"x" * 70_000, "too_large")])
def test_bad_events(tmp_path, body, issue):
    (tmp_path / "f.jsonl").write_bytes(body)
    reader = byte_feed.ByteFeedReader(str(tmp_path))
    with pytest.raises(ValueError, match=issue):
        [list(reader.read(p)) for p in reader.partitions({}, reader.latestOffset())]


# --- reordering --------------------------------------------------------------------------------


def test_items_leave_in_order_and_the_wait_is_bounded(spark, tmp_path, monkeypatch):
    """Item 0 of a stage comes last: all others wait in the state store, and the last micro-batch frees them."""
    items = [(s, i, [] if i % 4 == 2 else [f"{s}{i}.{k}" for k in range(i % 3 + 1)]) for s in "ab" for i in range(40)]
    late = [x for x in items if x[1] == 0]
    early = [x for x in items if x[1]]
    random.Random(1).shuffle(early)
    schema = "stage string, item bigint, payloads array<string>"
    monkeypatch.setenv("TZ", "UTC")
    kept = spark.conf.get(reorder.STORE[0])
    spark.conf.set(*reorder.STORE)
    try:
        released = []
        for n, part in enumerate((early[:30], early[30:] + early[:5], late)):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            query = incremental.run_available(reorder.in_order(stream), str(tmp_path / "out"), str(tmp_path / "state"))
            released.append(spark.read.parquet(str(tmp_path / "out")).count())
            if n == 1:
                assert query.lastProgress.stateOperators[0].numRowsTotal > 0
    finally:
        spark.conf.set(reorder.STORE[0], kept)
    total = sum(len(p) for _, _, p in items)
    assert released == [0, 0, total]
    for s in "ab":
        got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("stage") == s).orderBy("position").collect()
        assert [r.payload for r in got] == [p for x, _, ps in items if x == s for p in ps]
        assert [r.position for r in got] == list(range(len(got)))


# --- rounds ------------------------------------------------------------------------------------


def texts(rng):
    words = lambda n: " ".join(rng.choice(["mill", "race", "water", "stone", "wheel", "grain", "flour", "sluice"]) + str(rng.randrange(99)) for _ in range(n))
    bases = [words(80) for _ in range(6)]
    out = []
    for i in range(60):
        base = bases[i % 6]
        out.append(rng.choice([base, base.replace("mill", "mild", 1), base + ".", words(80), f"  {base} "]))
    return out + ["short", "short", None, ""]


def test_rounds_equal_one_run(spark, tmp_path):
    given = texts(random.Random(5))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id bigint, text string, digest string")
    whole = sorted(tuple(r) for r in dedup.package(docs).collect())
    folder = str(tmp_path / "index")
    for n, (low, high) in enumerate(((0, 13), (13, 40), (40, 99))):
        part = docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        rounds.dedup_round(part, folder, n)
        if n == 1:  # the same round again, as after a failure between its results and the next step
            rounds.dedup_round(part, folder, n)
    assert sorted(tuple(r) for r in rounds.results(spark, folder).collect()) == whole
    assert rounds.committed(spark, folder) == [0, 1, 2]
    assert {r.reason for r in rounds.results(spark, folder).collect()} >= {"exact_duplicate_corpus", "near_duplicate_corpus"}
