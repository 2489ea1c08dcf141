"""Quality rules as a bitmask ledger (native DataFrame functions only).

``measure`` evaluates every rule once per document and stores one failure bit
per rule beside the measurements.  ``apply_policy`` turns a stored ledger into
verdicts under any versioned policy (a mask of enforced rules) without reading
a text again, and ``ablations`` counts, from the bits alone, what each rule
removes and what only it removes.

Everything is row-local: no shuffle, no skew, no state.  Null texts count as
texts without words; empty tables give empty ledgers; ties do not arise; other
columns pass through ``measure`` untouched unless they carry one of its names,
in which case they are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import BLANK, split_words, whole

#: Rule names by bit.  A published bit never changes its meaning.
RULES = (
    "few_words",
    "repeated_words",
    "many_symbols",
    "duplicate_lines",
    "word_length",
    "shouting",
    "no_letters",
)
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that a version enforces.
POLICIES: Mapping[str, int] = {
    "base-1": BIT["few_words"] | BIT["repeated_words"],
    "full-1": sum(BIT.values()),
}


def _repeat_words(n_words: Column, windows: Column, ranked: Column, again: Column) -> Column:
    """Words inside a window that occurs twice or more.

    ``again`` holds the window values found repeatedly.  With the starts of
    their occurrences in order, each start adds the words up to the next start,
    three at most.
    """
    few = F.filter(
        F.transform(windows, lambda w, i: F.when(F.array_contains(again, w), i)), lambda i: i.isNotNull()
    )
    near = F.filter(
        F.transform(
            ranked,
            lambda s, k: F.when(
                (s["w"] == F.get(ranked, k - 1)["w"]) | (s["w"] == F.get(ranked, k + 1)["w"]), s["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    # A handful of values is looked up; more are found by their sorted neighbours.
    return F.when(F.size(again) == 0, F.array().cast("array<int>")).when(F.size(again) <= 12, few).otherwise(
        F.sort_array(near)
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger: ``docs`` with measurements and ``fail_bits`` (bigint)."""
    words = split_words(whole(F.col(text)), BLANK)
    lines = F.filter(F.split(whole(F.col(text)), "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    df = docs.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(whole(F.col(text)), F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_upper": F.regexp_count(whole(F.col(text)), F.lit(r"\p{Lu}")).cast("long"),
            "n_letters": F.regexp_count(whole(F.col(text)), F.lit(r"\p{L}")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_w": F.when(
                F.size("_words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.xxhash64(
                        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)
                    ),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    df = df.withColumn("_sorted", F.sort_array("_w"))
    df = df.withColumn(
        "_again",
        F.array_distinct(
            F.filter("_sorted", lambda w, k: (k > 0) & (w == F.get("_sorted", k - 1)))
        ),
    )
    df = df.withColumn(
        "_ranked",
        F.when(
            F.size("_again") > 12,
            F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    )
    df = df.withColumn("_at", _repeat_words(F.col("n_words"), F.col("_w"), F.col("_ranked"), F.col("_again")))
    df = df.withColumn(
        "n_repeat_words",
        F.aggregate(
            F.transform(
                "_at", lambda i, k: F.coalesce(F.least(F.lit(3), F.get("_at", k + 1) - i), F.lit(3))
            ),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        ),
    )
    n = F.col("n_words")
    fails = {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "many_symbols": 100 * F.col("n_symbols") > 15 * n,
        "duplicate_lines": (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "shouting": 2 * F.col("n_upper") > F.col("n_letters"),
        "no_letters": 2 * F.col("n_letters") < F.col("word_chars"),
    }
    bits = reduce(
        lambda a, b: a.bitwiseOR(b), (F.when(fails[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES)
    )
    return df.withColumn("fail_bits", bits.cast("long")).drop(
        "_words", "_lines", "_w", "_sorted", "_again", "_ranked", "_at"
    )


def apply_policy(ledger: DataFrame, mask: int) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy's mask."""
    return ledger.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base-1"])) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(mask | POLICIES["base-1"])) == 0,
        }
    )


def ablations(ledger: DataFrame, mask: int) -> DataFrame:
    """One row per enforced rule: what fails it, and what would come back without it.

    The distinct masks (2 to the number of rules at most) are counted first, so
    the rest works on a table of constant size.
    """
    by_bits = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count("*").alias("n")
    )
    rules = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                for r in RULES
                if BIT[r] & mask
            ]
        )
    ).alias("r")
    rows = by_bits.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_here"),
    )
