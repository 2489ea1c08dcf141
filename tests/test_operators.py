"""Literal cases for rules the given tables never fire, and invariants."""

import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import text as T
from millrace.functions import udfs
from millrace.operators import chunking, contracts, conversations, decontamination, dedup, quality, review

SENTENCES = [f"Sentence number {chr(97 + i)} tells of a {w} place in some detail." for i, w in enumerate(["quiet", "green", "open", "vast", "tiny", "plain"] * 4)]
BASE = " ".join(SENTENCES)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_text_gate(spark):
    cases = {
        None: "empty_text", " 　\n": "empty_text", "a�b": "invalid_encoding", "x sk-" + "a" * 16: "potential_secret",
        "密码：abc": None, "密码: abcdefgh1": "potential_secret", "Authorization: Bearer " + "a" * 16: "potential_secret",
        "-----BEGIN RSA PRIVATE KEY-----": "potential_secret", "call 13812345678 now": "potential_personal_data",
        "113812345678": None, "me@example.com": "potential_personal_data", "id 11010119900307451X": "potential_personal_data", "fine": None,
    }
    got = docs(spark, list(cases)).select(T.text_issue(F.col("text")).alias("i")).collect()
    assert [r.i for r in got] == list(cases.values())


def test_comparison_text_composes_and_folds(spark):
    t = "é   a　b\n"
    got = docs(spark, [t]).select(T.comparison_text(F.col("text")).alias("n")).first().n
    assert got == unicodedata.normalize("NFC", "é a b")


def test_verdicts(spark):
    texts = ["#" * 200, ("The same boilerplate line again.\n") * 30, "ab " * 200, BASE, "短文" * 10]
    got = [r.reason for r in quality.verdict(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["mostly_nontext_corpus", "repeated_boilerplate_corpus", "low_information_repetition", None, None]


def test_exact_and_near_policy(spark):
    near = BASE.replace("quiet place", "quiett place", 1)
    number = BASE.replace("detail.", "detail 7.", 1)
    code = BASE + " x = 1"
    texts = [BASE, near, BASE + "\n", number, code, code.replace("x = 1", "x = 2")]
    got = {r.doc_id: r for r in dedup.package(docs(spark, texts)).collect()}
    assert [got[i].reason for i in range(6)] == [None, "near_duplicate_corpus", "exact_duplicate_corpus", None, None, None]
    assert got[1].duplicate_of == got[2].duplicate_of == 0 and got[1].similarity >= 0.9
    sizes = {r.root: r["size"] for r in dedup.cluster_sizes(dedup.package(docs(spark, texts))).collect()}
    assert sizes[0] == 3


def test_released_and_current_precedence(spark):
    """Overlap before released rows, exact before near, before duplicates of the current run."""
    other = BASE.replace("Sentence", "Paragraph")
    near = lambda t: t.replace("quiet place", "quiett place", 1)
    passage = "An evaluation passage of a fair length, never to be trained on."
    ref = decontamination.checked(spark.createDataFrame([(1, passage)], "item_id bigint, text string"))
    prior = spark.createDataFrame([(100, BASE), (101, "short released row")], "doc_id bigint, text string")
    texts = [passage + " " + BASE, BASE + "\n", near(BASE), "short released row", other, near(other), other, "short fresh row", None]
    got = {r.doc_id: r.reason for r in decontamination.corpus_precedence(docs(spark, texts), ref, prior).collect()}
    assert [got[i] for i in range(9)] == [
        "evaluation_verbatim_overlap", "released_corpus_exact_duplicate", "released_corpus_near_duplicate", "released_corpus_exact_duplicate",
        None, "near_duplicate_corpus", "exact_duplicate_corpus", None, None,
    ]


def test_shingle_checksums_are_those_of_the_bytes():
    import zlib

    for t in ("plain ascii text of some length", "naïve été ß über", "混合 text 😀 with all widths ü", "short", ""):
        want = sorted({zlib.crc32(t[i : i + 7].encode()) for i in range(len(t) - 6)})
        assert T.shingle_checksums(t).tolist() == want
        assert len(T.shingle_hashes(t)) == len({t[i : i + 7] for i in range(len(t) - 6)})


def test_running_sums_over_groups(spark):
    rows = [("a", i, i % 3) for i in range(50)] + [(None, i, 1) for i in range(5)] + [("b", 7, 2)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(3)
    got = {(r.g, r.o): r.s for r in review.running(df, "g", ["-o"], F.col("v"), "s").collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p > o) for g, o, _ in rows}


def test_chain_resolution(spark):
    """a~b~c: b goes, so c, whose only neighbour is a duplicate, stays."""
    pairs = spark.createDataFrame([(2, 1, 0.95), (3, 2, 0.95), (5, 3, 0.9), (5, 4, 0.9)], "a bigint, b bigint, similarity double")
    assert {r.a: r.root for r in dedup.resolve(pairs).collect()} == {2: 1, 5: 3}


def test_reference_overlap(spark):
    passage = "An evaluation passage of a fair length, never to be trained on."
    refs = spark.createDataFrame([(1, passage), (2, "2+2=4 ok?"), (3, BASE)], "item_id bigint, text string")
    ref = decontamination.checked(refs)
    texts = ["see: " + passage + " end", "2+2=4 ok?", "why 2+2=4 ok? so", BASE.replace("green place", "greenn place", 1), BASE.replace("detail.", "detail 3.", 1)]
    got = [r.match for r in decontamination.precedence(docs(spark, texts), ref).orderBy("doc_id").collect()]
    assert got == ["embedded", "whole_record", None, "whole_record_near", None]
    with pytest.raises(ValueError, match="duplicate_record_id"):
        decontamination.checked(refs.unionByName(refs))
    with pytest.raises(ValueError, match="record_too_long"):
        decontamination.checked(spark.createDataFrame([(1, "x" * 20_001)], "item_id bigint, text string"))


MARKDOWN = "# One\n\nText a.\n\n```py\ncode\n\nmore\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n## Two\n" + "Word. " * 900 + "\n\n<table>\n<tr></tr>\n</table>\n\n  \n"


def test_structure_chunks():
    for target, text in ((40, MARKDOWN), (2000, MARKDOWN), (10, "x" * 95), (50, BASE)):
        chunks = udfs.structure_chunks(text, target)
        assert "".join(chunks) == text and all(c.strip() for c in chunks)
        assert sum("```py\ncode\n\nmore\n```" in c for c in chunks) == text.count("```py")
    assert udfs.structure_chunks(" \n") == []
    overlapped = udfs.structure_chunks(BASE, 100, 20)
    assert all(b.startswith(a[-20:]) for a, b in zip(overlapped, overlapped[1:], strict=False))
    nested = "a\n\n````md\n```py\nx\n```\n````\n\n~~~\n```\n~~~\nend"
    assert [k for k, *_ in udfs.blocks(nested)] == ["prose", "atomic", "prose", "atomic", "prose"]
    assert [k for k, *_ in udfs.blocks("| a |\n| - |\n<table>\nx")] == ["prose"]
    # Long prose is cut at a line, a sentence or a blank of its last half.
    assert udfs.structure_chunks("ab cd. ef gh ij", 10) == ["ab cd.", " ef gh ij"] and udfs.structure_chunks("abc def ghi", 9) == ["abc def ", "ghi"]


def test_paragraph_chunks(spark):
    def cut(text, target, overlap=0):
        return docs(spark, [text]).select(chunking.paragraphs(F.col("text"), target, overlap).alias("c")).first().c

    assert cut("a" * 25, 10, 2) == ["a" * 10, "a" * 10, "a" * 9]
    assert cut("p1\n\np2\n\n# H\n\np3", 100) == ["p1\n\np2", "# H\n\np3"]
    assert cut("abcd\n\nefgh\n \nijkl\n", 8, 2) == ["abcd\n\nefgh", "gh\n\nijkl"]
    assert cut(None, 10) == cut(" \n\n ", 10) == []


def test_repetition_cycles():
    assert udfs.repetition_cycle("We then add one to it. So it grows again. " * 12)["period"] == 2
    assert udfs.repetition_cycle(BASE) is None
    steps = udfs.repetition_cycle("".join(f"Step {i}: add the numbers up. " for i in range(12)))
    assert (steps["period"], steps["repetitions"], steps["start"]) == (1, 8, 0)
    assert udfs.repetition_cycle("```\n" + "We then add one to it. " * 12 + "\n```\n") is None
    assert udfs.repetition_cycle("> We then add one to it.\n" * 12) is None
    lines = "".join(f"A line of some length, number {i % 20} of the lot.\n" for i in range(200))
    assert udfs.dominated_by_lines(lines) and udfs.repetition_cycle(lines)["period"] == 20


def test_arithmetic():
    cases = {
        "2+3*4": 14, "(2+3)*4": 20, "-3+5": None, "2--1": None, "8//2": 4, "7//2": 3, "(1-4)//2": -2, "1//0": None, "2**3": None, "7/2": None,
        "100001": None, "99999*99999": None, "1+": None, "a": None, "": None, "()": None, "(1": None, "1 2": None, "007": None, "00": 0, " ( 1 ) ": 1,
        "+".join("1" * 24): 24, "+".join("1" * 25): None, "(" * 30 + "1" + ")" * 30: 1,
        "+".join(["(1+1+1+1)"] * 10 + ["1", "1", "1"]): 43, "+".join(["(1+1+1+1)"] * 10 + ["1", "1", "1", "1"]): None,
    }
    assert {x: udfs.evaluate(x) for x in cases} == cases
    c = udfs.canonical
    assert c("2 + 3") == c("(3+2)") and c("2 * (3 * 4)") == c("(4 * 2) * 3") and c("5-2") != c("2-5") and c("2*(3+4)") != c("2*3+2*4")
    assert c("3+2") == '["+",["int",2],["int",3]]' and c("2**3") is None


def test_conversation_issues(spark):
    rows = {
        1: [("user", "q"), ("assistant", "a")], 2: [("user", "q")], 3: [("assistant", "a")], 4: [("user", " "), ("assistant", "a")],
        5: [("robot", "q")], 6: [("user", "q"), ("tool", "x"), ("assistant", "a")], 7: [("user", "my key is sk-" + "a" * 20), ("assistant", "a")],
        8: [("user", "q"), ("assistant", "a"), ("user", "q"), ("assistant", "a")], 9: [("user", "q"), ("system", "s"), ("assistant", "a")],
        10: [("user", "q"), ("user", "q"), ("assistant", "a")], 11: [("user", "q"), ("assistant", "a"), ("assistant", "b")],
    }
    df = spark.createDataFrame([(c, t, r, x) for c, ms in rows.items() for t, (r, x) in enumerate(ms)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.issue for r in conversations.issues(df).collect()}
    assert got == {
        1: None, 2: "missing_final_answer", 3: "missing_user", 4: "empty_text", 5: "invalid_role", 6: "orphan_tool_result",
        7: "potential_secret", 8: None, 9: None, 10: None, 11: None,
    }
    done = {r.conv_id: (r.completed, r.issue) for r in conversations.completed_turns(df).collect()}
    assert done[8] == (2, None) and done[1] == (0, "insufficient_completed_turns") and done[9] == (0, "system_message_out_of_place")
    assert done[10] == (0, "unanswered_user_turn") and done[11] == (0, "assistant_without_user_turn")


def test_release_gate(spark):
    keep = spark.createDataFrame([(1, "keep")] * 15, "sample bigint, decision string")
    first = review.gate(review.consensus(keep, "sample")).first()
    assert (first.reviewed, first.kept, first.release) == (1, 1, False)
    mixed = keep.unionByName(spark.createDataFrame([(1, "reject")], keep.schema))
    second = review.gate(review.consensus(mixed, "sample")).first()
    assert (second.kept, second.conflicts) == (0, 1)


def test_languages_and_tokens(spark):
    rows = docs(spark, ["中文字符" * 4, "plain English words are seven in number", "123", "中a"]).select(
        T.language_share(F.col("text")).alias("s"), T.detect_language(F.col("text")).alias("d"), T.presence_language(F.col("text")).alias("p"),
        T.estimate_tokens(F.col("text")).alias("t"), T.search_tokens(F.col("text")).alias("k"),
    ).collect()
    assert [r.s for r in rows] == ["zh", "en", "other", "mixed"] and [r.d for r in rows] == ["zh", "en", "en", "zh"]
    assert [r.p for r in rows] == ["zh", "en_or_other", "en_or_other", "mixed"]
    assert rows[0].t == 16 and 5 <= rows[1].t <= 12 and "中文" in rows[0].k


def test_judge_suggestions(spark):
    cases = {'{"keep": true}': "keep", '{"pass": false}': "reject", '{"keep": "yes"}': None, '"keep": true': "keep", "": None, "false": "reject", "error 500": None}
    got = docs(spark, list(cases)).select(contracts.judge_suggestion(F.col("text")).alias("s")).collect()
    assert [r.s for r in got] == list(cases.values())


def _cell(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([_cell(y) for y in x])
    return f"{float(x):.9g}" if hasattr(x, "as_tuple") else str(x)


NAMES = sorted(__spark_entry__.catalog.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages", "embeddings", "events", "orders", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf_dir)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(_cell(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(_cell(r[c]) for c in names) for r in df.collect()) == expected
