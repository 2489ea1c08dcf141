"""Quotes bound to their places, memories merged, states of production."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ledgers, quotes, stats


def plain(source, quote):
    at = source.find(quote)
    if at >= 0:
        return at, at + len(quote), "exact"
    places = [i for i, c in enumerate(source) if not c.isspace()]
    found = "".join(source[i] for i in places).find("".join(quote.split()))
    return None if found < 0 else (places[found], places[found + len("".join(quote.split())) - 1] + 1, "pdf_whitespace")


def test_random_quotes_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(600):
        source = "".join(rng.choices("ab é\n\t", k=rng.randrange(1, 40)))
        quote = "".join(rng.choices("ab é\n", k=rng.randrange(1, 5)))
        got = quotes.bound(source, [quote], True)
        want = plain(source, quote) if quote.strip() else None
        assert (got and (got[0]["start"], got[0]["end"], got[0]["match"])) == want
        assert got is None or got[0]["source_quote"] == source[got[0]["start"] : got[0]["end"]]


@pytest.mark.parametrize("source,asked,pdf,n", [("a b", ["ab"], False, None), ("a b", ["ab"], True, 1), ("a b", ["a", "b"], False, 2), ("a", [" "], True, None), (None, ["a"], True, None), ("a", [], True, None), ("a", None, True, None)])
def test_quotes_that_are_absent(spark, source, asked, pdf, n):
    df = spark.createDataFrame([(source, asked, pdf)], "s string, q array<string>, p boolean")
    got = df.select(quotes.quote_spans(F.col("s"), F.col("q"), F.col("p")).alias("x")).first().x
    assert (got and len(got)) == n


def test_memories_of_one_identity_keep_all_sources(spark):
    rows = [("t", "c", "s1"), ("t", "c", "s2"), ("t", "c", "s1"), ("t", "d", "s1"), (None, "c", None)]
    got = ledgers.merged_memory(spark.createDataFrame(rows, "title string, content string, source string"), ["title", "content"], "source").collect()
    assert {(r.title, r.content): (sorted(r.sources), r.entries) for r in got} == {("t", "c"): (["s1", "s2"], 3), ("t", "d"): (["s1"], 1), (None, "c"): ([], 1)}
    assert len({r.id for r in got}) == 3


def test_production_state_counts_every_goal(spark):
    receipts = spark.createDataFrame([(1, "a", 3, 5), (2, "a", 4, 9), (1, "x", 9, 9)], "round int, target string, eligible int, attempted int")
    got = {r.target: (r.eligible, r.attempted, r.remaining, r.rounds) for r in stats.production_state(receipts, {"a": 10, "b": 2}).collect()}
    assert got == {"a": (7, 14, 3, 2), "b": (0, 0, 2, 0)}
