"""Claims, evidence, issues, supervision and receipts against brute force on small inputs."""

import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.operators import conversations, evidence
from millrace.streaming import incremental


def test_review_windows(spark):
    rng = random.Random(3)
    rows = [(r, i, None if rng.random() < 0.1 else "x" * rng.choice((0, 5, 30, 99, 150))) for r in range(20) for i in range(rng.randrange(1, 40))]
    expected = set()
    for r in range(20):
        window, units, chars = 0, 0, 0
        for _, i, text in [x for x in rows if x[0] == r]:
            n = len(text or "")
            if units and (units >= 4 or chars + n > 120):
                window, units, chars = window + 1, 0, 0
            units, chars = units + 1, chars + n
            expected.add((r, i, window))
    df = spark.createDataFrame(rows, "r int, i int, text string")
    assert {tuple(x) for x in evidence.review_windows(df, "r", "i", "text", 4, 120).collect()} == expected
    assert evidence.review_windows(df.filter("r < 0"), "r", "i", "text").collect() == []


def test_halves(spark):
    df = spark.createDataFrame([([],), ([1],), ([1, 2],), ([1, 2, 3],)], "ids array<int>")
    assert [r.h for r in df.select(evidence.halves(F.col("ids")).alias("h")).collect()] == [None, None, [[1], [2]], [[1], [2, 3]]]


def test_half_comparisons(spark):
    numbers = ["50", "50.0", "50.000000000000000000000000000000000000001", "49.99", "051", "0", "999999999999999999999999999999999999999999"]
    phrases = {"less than half": Decimal.__lt__, "More than half": Decimal.__gt__, "at least half": Decimal.__ge__, "至多一半": Decimal.__le__}
    rows = [(f"{n}%, {p}.", "asserted", "claim") for n in numbers for p in phrases]
    expected = ["verified" if f(Decimal(n), Decimal(50)) else "violated" for n in numbers for f in phrases.values()]
    rows += [
        ("Nothing of the kind.", "asserted", "claim"), (None, "asserted", "claim"), ("If 40%, less than half.", "asserted", "claim"),
        ("40% of 30% is less than half.", "asserted", "claim"), ("less than half", "asserted", "claim"),
        ("The authors did not report it.", "asserted", "claim"), ("论文没有报告该结果。", "asserted", "claim"),
        ("40%, less than half.", "negated", "claim"), ('It is wrong to say "more than half".', "quoted", "not_claim"),
    ]
    expected += [None, None, "unresolved", "unresolved", "unresolved", "unresolved", "unresolved", "unresolved", "verified"]
    df = spark.createDataFrame(rows, "quote string, stance string, claim string").coalesce(1)
    got = df.select(evidence.half_comparison(F.col("quote"), F.col("stance"), F.col("claim"))["status"].alias("s")).collect()
    assert [r.s for r in got] == expected


def test_issue_store(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice(("x", "y", None))) for i in range(60)]
    live, kept, by = {}, {}, {}
    for key, i, said in rows:
        if key in live and live[key][1] == said:
            continue
        if key in live:
            by[live[key][0]] = i
        live[key], kept[i] = (i, said), key
    store = evidence.issue_store(spark.createDataFrame(rows, "k string, i int, said string"), ["k"], "i", ["said"])
    assert {(r.i, r.superseded_by) for r in store.collect()} == {(i, by.get(i)) for i in kept}
    events = spark.createDataFrame([(live["a"][0], 1, "completed"), (live["a"][0], 2, "needs_revision")], "i int, seq int, status string")
    queue = evidence.next_issues(store, events, "i", "seq", "i", 5).collect()
    assert [(r.i, r.status) for r in queue] == [(live["b"][0], "pending"), (live["a"][0], "needs_revision")]


def _supervised(ids, labels, mask, eos, trailing):
    if not ids or labels is None or mask is None or not len(ids) == len(labels) == len(mask):
        return "training_validation_invalid_token_alignment"
    first = next((i for i, x in enumerate(labels) if x != -100), None)
    if not first or labels[first:] != ids[first:] or eos not in labels[first:]:
        return "training_validation_incomplete_supervision"
    last = max(i for i, x in enumerate(labels) if x == eos)
    return None if set(ids[last + 1 :]) <= set(trailing) else "training_validation_incomplete_supervision"


def test_supervision(spark):
    rng = random.Random(7)
    rows = [([], [], []), (None, [1], [1]), ([5, 2], None, [1, 1]), ([5, 2], [-100, 2], [1]), ([5, 2], [5, 2], [1, 1]), ([5, 2, 9], [-100, 2, 9], [1] * 3)]
    for _ in range(300):
        ids = [rng.choice((2, 9, 5, 6)) for _ in range(rng.randrange(1, 7))]
        masked = rng.randrange(0, len(ids) + 1)
        labels = [-100] * masked + ids[masked:]
        if rng.random() < 0.2:
            labels[rng.randrange(len(labels))] = rng.choice((-100, 6))
        rows.append((ids, labels, [1] * len(ids)))
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, c array<int>").coalesce(1)
    for trailing in ((), (9,)):
        got = df.select(evidence.supervision(F.col("a"), F.col("b"), F.col("c"), 2, trailing).alias("s")).collect()
        expected = [_supervised(*r, 2, trailing) for r in rows]
        assert [r.s.issue for r in got] == expected and None in expected
        for (ids, labels, _), r, issue in zip(rows, got, expected):
            if issue is None:
                first = labels.count(-100)
                last = max(i for i, x in enumerate(labels) if x == 2)
                assert tuple(r.s) == (None, first, len(ids) - first, last)


def test_source_conversations_and_previews(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "see sk-" + "a" * 20),
        (2, 0, "user", "y" * 300), (2, 1, "assistant", "fine"),
        (3, 0, "user", "one"), (3, 1, "assistant", ""), (3, 2, "tool", None), (4, 0, "user", "hi"), (4, 1, "assistant", "there"),
    ]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    issues = {r.conv_id: r.issue for r in conversations.source_issues(turns, 200).collect()}
    assert issues == {1: "potential_secret", 2: "context_exceeds_auto_limit", 3: "empty_message", 4: None}
    shown = {r.conv_id: r.preview for r in conversations.preview(turns).collect()}
    assert shown[4] == "【user】hi\n\n【回答】there" and shown[3] == "【user】one\n\n【工具结果✔】"


def test_shard_receipts(spark, tmp_path):
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    watch = lambda: incremental.shard_receipts(incremental.files(spark, source, "text string", 1), "text", out, marks)
    one = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").json(source)
    receipts = lambda: spark.read.parquet(out)
    one("a", " ", "bcd")
    one("ef")
    watch()
    assert sorted((r.rows, r.chars, r.blank) for r in receipts().collect()) == [(1, 2, 0), (3, 5, 1)]
    one("g", "h")
    watch()
    got = receipts().collect()
    assert sorted(r.rows for r in got) == [1, 2, 3] and len({r.file for r in got}) == 3
    assert all(re.search(r"\.json$", r.file) for r in got)
