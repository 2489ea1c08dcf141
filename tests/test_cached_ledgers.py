"""File signatures, cached statistics, history import, equal answers, observed states, term samples."""

import hashlib
import heapq
import json
import random
import re
import unicodedata
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import distribution, equivalence, history, history_import, observations
from millrace.sources import changed_files

# --- changed files -----------------------------------------------------------------------------


def test_only_changed_files_are_read_again(spark, tmp_path):
    top, cache = tmp_path / "in", str(tmp_path / "cache")
    top.mkdir()
    seen = []

    def derive(paths):
        seen.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))

    def refresh():
        got = changed_files.refresh(spark, str(top), cache, derive, "file string, line string")
        return sorted((r.file.rsplit("/", 1)[1], r.line) for r in got.rows.collect()), got.files, got.read

    assert refresh() == ([], 0, 0)
    (top / "a").write_text("1\n2\n")
    (top / "b").write_text("3\n")
    assert refresh() == ([("a", "1"), ("a", "2"), ("b", "3")], 2, 2)
    assert refresh() == ([("a", "1"), ("a", "2"), ("b", "3")], 2, 0)
    (top / "a").write_text("4\n")
    (top / "c").write_text("5\n")
    assert refresh() == ([("a", "4"), ("b", "3"), ("c", "5")], 3, 2)
    (top / "b").unlink()
    assert refresh() == ([("a", "4"), ("c", "5")], 2, 0)
    assert seen == [["a", "b"], ["a", "c"]]


def test_files_that_change_while_read_commit_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1\n")

    def derive(paths):
        rows = spark.createDataFrame([(paths[0], "x")], "file string, line string")
        (tmp_path / "in" / "a").write_text("longer than before\n")
        return rows

    with pytest.raises(ValueError, match="source_changed_while_read"):
        changed_files.refresh(spark, str(tmp_path / "in"), str(tmp_path / "cache"), derive, "file string, line string")
    assert changed_files.known(spark, str(tmp_path / "cache")).count() == 0


# --- distribution ------------------------------------------------------------------------------


def m(role, content, reasoning=None, tool_calls=0, images=0):
    return {"role": role, "content": content, "reasoning": reasoning, "tool_calls": tool_calls, "images": images}


RECORDS = [
    ("sft", None, [m("system", "abc"), m("user", "你好 hi"), m("assistant", "好" * 300, "think")], None, None, None),
    ("sft", None, [m("user", "x"), m("assistant", None, tool_calls=1), m("tool", "result"), m("assistant", "done")], None, False, None),
    ("sft", None, [m("assistant", "12")], None, None, None),
    ("cpt", "plain text 1", None, None, True, None),
    ("cpt", None, None, None, None, None),
    ("cot", "12 34", None, "因为", None, True),
    ("agent_negative", None, [m("user", "q", images=1)] * 7, None, None, None),
]


def test_the_ten_measures_and_their_total(spark):
    parts = distribution.partials(spark.createDataFrame([(*r, f"shard{i % 3}") for i, r in enumerate(RECORDS)], distribution.RECORD + ", shard string"), "shard", "target")
    got = {r.target: r.asDict() for r in distribution.report(parts).collect()}
    assert {k: v["rows"] for k, v in got.items()} == {"sft": 3, "cpt": 2, "cot": 1, "agent_negative": 1, "total": 6}
    sft = got["sft"]
    assert (sft["body_chars"], sft["reasoning_chars"], sft["reasoning_rows"], sft["tool_rows"], sft["image_rows"]) == (5 + 300 + 1 + 4 + 2, 5, 1, 1, 0)
    assert sft["languages"] == {"zh": 1, "en": 1, "mixed": 0, "other": 1} and sft["user_languages"] == {"zh": 0, "en": 1, "mixed": 1, "other": 0, "none": 1}
    assert sft["turns"] == {"0": 1, "1": 2, "2": 0, "3–5": 0, "6+": 0}
    assert sft["lengths"]["201–1,000"] == 1 and sft["reasoning_lengths"]["0–200"] == 1 and sum(sft["reasoning_lengths"].values()) == 1
    assert got["agent_negative"]["turns"]["6+"] == 1 and got["agent_negative"]["image_rows"] == 1
    assert got["total"]["image_rows"] == 1 and got["total"]["tool_rows"] == 2
    # Merged from parts of parts, in any order: the same.
    again = distribution.merged(distribution.merged(parts, "target").withColumn("run", F.lit(1)), "target", "run")
    assert {r.target: r.rows for r in again.collect()} == {k: v["rows"] for k, v in got.items() if k != "total"}
    assert distribution.report(distribution.partials(spark.createDataFrame([], distribution.RECORD), "target")).count() == 0


# --- history import ----------------------------------------------------------------------------


def test_history_is_imported_by_file(spark, tmp_path):
    top, cache = tmp_path / "in", str(tmp_path / "cache")
    top.mkdir()

    def line(position, a, sign, b, value, status=None):
        text = f"{a} {sign} {b}"
        return json.dumps({"position": position, "expression": text, "answer": f"<<{text}={value}>> #### {value}", "status": status})

    (top / "a.jsonl").write_text("\n".join([line(1, 2, "+", 3, 5), line(2, 3, "+", 2, 5), line(3, 7, "-", 2, 5), json.dumps({"position": 4, "status": "skipped"})]))
    (top / "b.jsonl").write_text("\n".join([line(1, 2, "+", 3, 5), line(2, 4, "*", 2, 8)]))
    (top / "c.jsonl").write_text("\n".join([line(1, 9, "+", 9, 18), line(2, 9, "*", 2, 17)]))

    def run():
        got = history_import.imported(spark, str(top), cache)
        totals = {r.file.rsplit("/", 1)[1][0]: (r.added, r.duplicate, r.invalid) for r in got.totals.collect()}
        return sorted(r.expression for r in got.ledger.collect()), totals, got.read

    assert run() == (["2 + 3", "4 * 2", "7 - 2"], {"a": (2, 1, 0), "b": (1, 1, 0), "c": (0, 0, 1)}, 3)
    (top / "c.jsonl").write_text(line(1, 9, "+", 9, 18))
    (top / "a.jsonl").write_text(line(1, 7, "-", 2, 5))
    assert run() == (["2 + 3", "4 * 2", "7 - 2", "9 + 9"], {"a": (1, 0, 0), "b": (2, 0, 0), "c": (1, 0, 0)}, 2)


# --- equal answers -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a,b,status",
    [
        ("1/2", "0.5", "matched"), ("50%", "1/2", "matched"), ("$\\frac{1}{2}$", "$$.50$$", "matched"), ("-0.0", "0", "matched"), ("-1/3", "1/3", "mismatched"),
        ("0.3333333333", "1/3", "mismatched"), ("2", "2.", "matched"), ("\\dfrac{1.5}{3}", "50\\%", "matched"), ("+7", "7", "matched"), ("1e3", "1000", "unresolved"),
        ("5 apples", "5", "unresolved"), ("1 2", "12", "unresolved"), ("1/0", "1", "unresolved"), ("2*3", "6", "unresolved"), ("", "", "unresolved"), (None, "1", "unresolved"),
        ("123456789012345678", "123456789012345678.0", "unresolved"), ("123456789012345678", "123456789012345679", "mismatched"), ("0.1", "0.10000000000000001", "mismatched"),
        ("\\text{2}", "2", "unresolved"), ("x", "x", "unresolved"),
    ],
)
def test_equal_numbers(spark, a, b, status):
    row = equivalence.compared(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first()
    assert row.status == status


def test_random_fractions_agree_with_exact_ones(spark):
    rng = random.Random(6)

    def written():
        a, b = rng.randrange(40), rng.randrange(1, 12)
        s = rng.choice(["", "-"])
        text, value = rng.choice([(f"{a}/{b}", Fraction(a, b)), (f"\\frac{{{a}}}{{{b}}}", Fraction(a, b)), (f"{a}.{b}", Fraction(f"{a}.{b}")), (f"{a}.{b}%", Fraction(f"{a}.{b}") / 100), (f"{a}.5/{b}.25", Fraction(f"{a}.5") / Fraction(f"{b}.25"))])
        return s + text, -value if s else value

    pairs = [(written(), written()) for _ in range(400)] + [(x, x) for x in (written() for _ in range(50))]
    df = spark.createDataFrame([(i, x[0], y[0]) for i, (x, y) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.status for r in equivalence.compared(df, "a", "b").collect()}
    assert got == {i: "matched" if x[1] == y[1] else "mismatched" for i, (x, y) in enumerate(pairs)}


# --- observations ------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_actions_count_where_the_table_lets_them(spark, monkeypatch, block):
    monkeypatch.setattr(observations, "BLOCK", block)
    rng = random.Random(block)
    names = ["claim", "bind", "propose", "no_update", "fail", "release", "unheard", None]
    rows = [(k, i, rng.choice(names)) for k in range(12) for i in range(rng.randrange(1, 30))]
    expected = {}
    for k, _, action in sorted(rows, key=lambda r: r[:2]):
        state, yes, no = expected.get(k, ("pending", 0, 0))
        to = observations.OBSERVATIONS.get((state, action))
        expected[k] = (to or state, yes + bool(to), no + (not to))
    got = observations.folded(spark.createDataFrame(rows, "k int, at int, action string").repartition(3), observations.OBSERVATIONS, ["k"], "at")
    assert {r.k: (r.state, r.accepted, r.refused) for r in got.collect()} == expected


def test_batches_hold_what_fits(spark):
    rows = [("a", i, n) for i, n in enumerate([10, 20, 30, 5])] + [("b", 1, 999), ("b", 2, 1), ("c", 1, 58)]
    df = spark.createDataFrame(rows, "scope string, at int, chars int")
    got = observations.claimable(df, "scope", "at", "chars", 3, 60).orderBy("scope", "at").collect()
    # As one JSON array: [10] is 12, [10,20] is 33, with 30 more it is 64.
    assert [tuple(r) for r in got] == [("a", 0, "claimed", 12), ("a", 1, "claimed", 33), ("b", 1, "needs_capacity", 1001), ("c", 1, "claimed", 60)]


def test_gates_and_unknown_ones(spark):
    rows = [(1, "G0", 1, "propose"), (1, "G0", 2, "approve"), (1, "G3", 3, "propose"), (1, "G9", 4, "approve"), (2, "G0", 1, "reject"), (3, "G1", 1, "reject"), (3, "G9", 2, "propose")]
    events = spark.createDataFrame(rows, "run int, gate string, at int, action string")
    got = {(r.run, r.gate): (r.status, r.blocked) for r in observations.gates({"G0": False, "G1": True, "G3": False}, events, ["run"], "at").collect()}
    assert len(got) == 9 and got[1, "G0"] == ("approved", False) and got[1, "G3"] == ("awaiting", True) and got[2, "G0"] == ("rejected", True)
    assert got[2, "G3"] == ("pending", True) and got[3, "G1"] == ("approved", False)
    assert [r.run for r in observations.unknown_gates({"G0": False}, events.filter("gate = 'G9'")).collect()] == [1]


# --- term samples and likeness -----------------------------------------------------------------

HAN = re.compile(r"[㐀-鿿]+")
WORDS = re.compile(r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)*")


def plain_terms(question, k=48):
    norm = " ".join(unicodedata.normalize("NFKC", question).casefold().split()).rstrip("?？ ")
    words = WORDS.findall(norm)
    out = {"w:" + w for w in words} | {f"w:{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    for run in HAN.findall(norm):
        out |= {"c:" + run} if len(run) == 1 else {"c:" + run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)}
    return heapq.nsmallest(k, out, key=lambda t: (hashlib.blake2b(t.encode(), digest_size=8).digest(), t))


QUESTIONS = ["What is 3.5 + 2?", "What's the plan ", "为什么水会结冰？", "水", "ＦＵＬＬ width 12%", "Straße", "a", "", " ? ", "one two three four five " * 30, "中 文字 test中文"]


def test_terms_of_questions(spark):
    df = spark.createDataFrame(list(enumerate(QUESTIONS)) + [(99, None)], "row_id int, question string")
    got = {r.row_id: r.terms for r in history.index(df).collect()}
    assert got.pop(99) == [] and got == {i: plain_terms(q) for i, q in enumerate(QUESTIONS)}


def test_likeness_equals_the_plain_search(spark, monkeypatch):
    rng = random.Random(8)
    for name, value in (("RAREST", 5), ("POSTINGS", 8), ("CANDIDATES", 12)):
        monkeypatch.setattr(history, name, value)
    words = [f"{a}{b}" for a in "bcd" for b in "aeiou"] + ["12", "3.5", "水冰"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(80)] + ["ba be", "ba be"]
    sampled = [plain_terms(t) for t in texts]
    numbers = [re.findall(r"[-+]?\d+(?:\.\d+)?(?:[%％])?", t) for t in texts]
    df = Counter(t for s in sampled for t in s)
    expected = []
    for q in range(0, len(texts), 7):
        rare = sorted(sampled[q], key=lambda t: (df[t], t))[:5]
        hits = Counter()
        for t in rare:
            hits.update(sorted((i for i, s in enumerate(sampled) if t in s), reverse=True)[:8])
        found = sorted(hits, key=lambda i: (-hits[i], -i))[:12]
        scored = [(i, round(2 * len(set(sampled[q]) & set(sampled[i])) / (len(sampled[q]) + len(sampled[i])), 6), numbers[i] == numbers[q]) for i in found]
        scored.sort(key=lambda x: (-x[1], x[0]))
        expected += [(q, *x, n) for n, x in enumerate(scored[:4], 1)]
    indexed = history.index(spark.createDataFrame(list(enumerate(texts)), "row_id int, question string"))
    got = history.similar(indexed, indexed.filter("row_id % 7 = 0"), 4).select("query", "row_id", "score", "same_numbers", "rank").collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_sample_of_rows_equals_sample_of_arrays(spark):
    rows = [(k, f"t{i % 70}") for k in range(5) for i in range(200 * (k + 1))]
    df = spark.createDataFrame(rows, "id int, term string").withColumn("h", F.md5("term"))
    got = history.bottom(df, "id", "term", "h", 9).collect()
    want = heapq.nsmallest(9, {t for _, t in rows}, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert all(sorted((r.place, r.term) for r in got if r.id == k) == list(enumerate(want, 1)) for k in range(5))
