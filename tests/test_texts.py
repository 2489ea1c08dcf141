"""Control phrases, LaTeX chunks and review units."""

import random
import re

import pytest

from millrace.operators import latex, marking, review_units
from millrace.operators.marking import Marker, Rule

A, Z = "<reason-strength>", "</reason-strength>"
RULES = [Rule("five", ("level 5", "desired level 5"), "[[FIVE]]"), Rule("link", ("and",), "[[LINK]]", "(link)")]


@pytest.mark.parametrize(
    "text,marked",
    [
        ("desired level 5 is not level 50 or level 5.0", f"{A}desired level 5{Z} is not level 50 or level 5.0"),
        ("sand and", f"sand {A}and{Z}"), (f"{A}and{Z} and", f"{A}and{Z} {A}and{Z}"), ("[[LINK]]", f"{A}[[LINK]]{Z}"),
        (f"{A}other and{Z} and", f"{A}other and{Z} {A}and{Z}"), ("x" * 509 + " and", "x" * 509 + " and"),
        ("x" * 508 + " and", "x" * 508 + f" {A}and{Z}"), ("x" * 600 + Z, "x" * 600 + Z), ("", ""),
    ],
)
def test_marks(text, marked):
    out, notes = Marker(RULES).run(text, False)
    assert out == marked and all(text[n.start : n.end] == n.original for n in notes)
    assert Marker(RULES).run(out, False)[0] == out  # a marked text is not marked again


def test_replacements_take_their_pair_with_them():
    out, notes = Marker(RULES).run(f"a {A}and{Z} b and level 5", True)
    assert out == f"a (link) b (link) {A}level 5{Z}"
    assert [(n.original, n.replacement) for n in notes] == [(f"{A}and{Z}", "(link)"), ("and", "(link)"), ("level 5", None)]


@pytest.mark.parametrize("text", [Z, A, f"{A}{A}x{Z}", f"{A}x{Z}{Z}", f"and {A}and"])
def test_unpaired_tags(spark, text):
    rows = marking.mark(spark.createDataFrame([(text,), (None,), ("and",)], "text string"), Marker(RULES)).collect()
    assert (rows[0].marked.issue, rows[0].marked.text) == ("control_text_unbalanced_tags", text)
    assert rows[1].marked.text is None and rows[2].marked.text == f"{A}and{Z}"


def test_a_pair_begun_in_the_prefix_may_end_beyond_it():
    text = f"{A}" + "y" * 700 + A + f"{Z} and {Z}"
    assert Marker(RULES).run(text, False)[0] == text


@pytest.mark.parametrize(
    "rules,issue",
    [
        ([Rule("a", ("x",), "m"), Rule("b", ("x",), "n")], "conflict"), ([Rule("a", ("xmy",), "m")], "conflict"), ([Rule("a", (" ",), "m")], "invalid_control_text_rule"),
        ([Rule("a", ("x",), "m", "a x")], "cascade"), ([Rule("a", (f"x{A}",), "m")], "conflict"), ([Rule("a", ("x",), "m", Z)], "cascade"),
        ([Rule("a", ("x",), "m"), Rule("a", ("y",), "n")], "conflict"),
    ],
)
def test_bad_tables(rules, issue):
    with pytest.raises(ValueError, match=issue):
        Marker(rules)


def test_task_references(spark):
    df = spark.createDataFrame([("and", "this and that"), ("and", "sand"), ("level 5", "and"), ("and", None)], "text string, task string")
    found = marking.mark(df, Marker(RULES))
    assert [r[0] for r in found.select(marking.task_references(found, Marker(RULES), "task")).collect()] == [True, False, False, False]


# --- LaTeX -------------------------------------------------------------------------------------

ATOMS = [
    r"\begin{equation}" + "x + " * 30 + r"\end{equation}", r"\begin{align}\begin{align} a b c \end{align}" + " y" * 40 + r"\end{align}",
    "$$" + "a b " * 20 + r"\$ $$", r"\[" + "a b " * 20 + r"\]", r"\newcommand{\foo}[1]{" + "a b " * 20 + "}", r"\verb|" + "a % $ { " * 9 + "|",
    r"\begin{verbatim}" + r" $ { \end{x} " * 9 + r"\end{verbatim}", r"\foo[a b]{c d}{" + "e f " * 15 + "}", r"\def\x#1 #2{" + "a b " * 20 + "}",
]


@pytest.mark.parametrize("atom", ATOMS)
def test_what_must_stay_whole_does(atom):
    text = "Before the structure.\n\n" + atom + "\n\nAfter the structure."
    got = latex.chunks(text, 40)
    assert any(atom in c for c in got) and any(len(c) > 40 for c in got)
    assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)


def test_many_formulas_and_random_mixtures():
    text = " ".join(f"item {i} $x_{{{i}}}=1$" for i in range(300))
    got = latex.chunks(text, 50)
    assert all(len(c) <= 50 for c in got) and all(any(f"$x_{{{i}}}=1$" in c for c in got) for i in range(300))
    rng = random.Random(2)
    for _ in range(60):
        parts = [rng.choice([*ATOMS, "$a b$$c d$", "some words of prose", "\n\n", r"\emph{x y}", r"100\%"]) for _ in range(12)]
        text, target = " ".join(parts), rng.choice([10, 60, 300])
        got = latex.chunks(text, target)
        assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)
        for a in ATOMS:
            assert sum(c.count(a) for c in got) == text.count(a)


@pytest.mark.parametrize(
    "text,issue",
    [
        (r"\begin{equation} x", "latex_unclosed_environment"), ("$x", "latex_unclosed_math"), (r"\[ x", "latex_unclosed_math"),
        (r"\foo{ x", "latex_unbalanced_group"), (r"\verb|x", "latex_invalid_verbatim"), (r"\begin{verbatim} x", "latex_invalid_verbatim"),
    ],
)
def test_unsafe_texts_are_reported(spark, text, issue):
    rows = latex.chunked(spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "plain")], "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, None, issue), (4, 0, "plain", None)]


# --- review units ------------------------------------------------------------------------------


def cut(text, fine=False):
    return [text[a:b] for a, b in review_units.spans(text, fine)]


def test_paragraphs_items_and_clauses():
    assert cut("  判断😀。\r\n\r\n前提成立。\r\n- **保留否定**。\r\n- 保留数量 12。\r\n") == ["判断😀。", "前提成立。", "- **保留否定**。", "- 保留数量 12。"]
    assert cut("Dr. Smith came, but late; fine. No! \"Yes.\" e.g. x", True) == ["Dr. Smith came,", "but late;", "fine.", "No!", '"Yes."', "e.g. x"]
    assert cut("One. Two. Three.") == ["One. Two. Three."] and cut("") == [] and cut(" \n ") == []


BLOCKS = [
    "```python\n" + "x = 'Do not split. '  # 否定。\n" * 40 + "\nprint(x)\n```", "~~~text\n" + "literal.\n" * 80 + "\n- still code\n~~~",
    "    x = 1.\n\n" + "    y = 'Not a prose sentence.'\n" * 40, "$$\n" + r"x=1.0+\text{not. equal.}" * 40 + "\n\n$$",
    r"\[" + r"x=1.0+\text{not. equal.}" * 40 + r"\]", "<pre>" + "not. prose.\n\n" * 80 + "</pre>", "`" + "Do not split. " * 70 + "`",
]


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("fine", [False, True])
def test_code_and_formulas_stay_whole(block, fine):
    text = "Before.\n\n" + "A clear sentence. " * 60 + "\n\n" + block + "\n\nAfter. And more."
    got = cut(text, fine)
    assert any(block.strip() in x for x in got)
    assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)


def test_ids_run_through_the_fields_of_a_message(spark):
    rows = [(7, 3, 0, "reasoning", "First.\n\nSecond."), (7, 3, 1, "tool_calls", ' {"a": 1}\n\n '), (7, 3, 2, "content", "😀 one. two"), (7, 4, 0, "content", None)]
    df = spark.createDataFrame(rows, "conv bigint, message int, at int, field string, text string")
    got = review_units.units(df, ["conv"], "message", "at", fine=True).orderBy("id").collect()
    assert [(r.id, r.field, r.start, r.text) for r in got] == [
        ("m3u0001", "reasoning", 0, "First."), ("m3u0002", "reasoning", 8, "Second."), ("m3u0003", "tool_calls", 1, '{"a": 1}'),
        ("m3u0004", "content", 0, "😀 one."), ("m3u0005", "content", 7, "two"),
    ]


def test_spans_cover_random_texts():
    rng = random.Random(4)
    parts = ["word. ", "And so, but ", "\n\n", "`a. b`", "$x. y$", "\\( z. ", "\\)", "    in. dent\n", "```\n", "- item\n", "<code>c. d</code>", "。", "`", "$", "\\"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 25)))
        for fine in (False, True):
            spans = review_units.spans(text, fine)
            assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
            held = {i for a, b in spans for i in range(a, b)}
            assert all(i in held for i, c in enumerate(text) if not c.isspace())
            assert not any(review_units.inside(review_units.protected(text), a) for a, _ in spans[1:])
