"""Text quality: gate, signals, verdict and repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def gated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``issue``: the first failed gate or null."""
    return docs.withColumn("issue", T.text_issue(F.col(text)))


def signals(docs: DataFrame, text: str = "text", grams: Column | None = None) -> DataFrame:
    """``docs`` with norm, visible_chars, substantive, norm_chars, grams, line_chars, repeated_chars,
    short_lines and n_lines.  All row-local; composition to NFC and the count of shingles leave the JVM,
    the latter only where ``grams`` (all rows by default) holds."""
    t = F.col(text)
    df = docs.withColumn("norm", T.comparison_text(t)).withColumn("_lines", T.lines(t))
    long = F.filter("_lines", lambda x: F.length(x) >= 12)
    total = lambda arr: F.aggregate(arr, F.lit(0), lambda a, x: a + F.length(x))
    df = df.withColumns(
        {
            "visible_chars": F.length(F.when(T.is_ascii(t), F.regexp_replace(t, r"[ \t-\r]+", "")).otherwise(F.regexp_replace(t, r"(?U)\s+", ""))),
            "substantive": F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")),
            "norm_chars": F.length("norm"),
            "n_lines": F.size("_lines"),
            "line_chars": total(F.col("_lines")),
            "repeated_chars": total(long) - total(F.array_distinct(long)),
            "short_lines": F.size(F.filter("_lines", lambda x: F.length(x) < 30)),
        }
    ).drop("_lines")
    return df.withColumn("grams", T.shingle_count(F.col("norm") if grams is None else F.when(grams, F.col("norm"))))


def verdict(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with reason (null: kept): the gate first, then the three pathologies."""
    # Shingles are counted for texts alone that passed the gate and are long enough for the rule.
    df = signals(gated(docs, text), text, F.col("issue").isNull() & (F.col("visible_chars") >= T.NEAR_MIN_CHARS))
    windows = F.greatest(F.lit(1), F.col("norm_chars") - T.SHINGLE + 1)
    reason = (
        F.when(F.col("issue").isNotNull(), F.col("issue"))
        .when((F.col("visible_chars") >= 120) & (F.col("substantive") / F.col("visible_chars") < 0.10), "mostly_nontext_corpus")
        .when(
            (F.col("visible_chars") >= T.NEAR_MIN_CHARS)
            & (F.col("repeated_chars") / F.greatest(F.lit(1), F.col("line_chars")) >= 0.80),
            "repeated_boilerplate_corpus",
        )
        .when((F.col("visible_chars") >= T.NEAR_MIN_CHARS) & (F.col("grams") / windows < 0.08), "low_information_repetition")
    )
    return df.withColumn("reason", reason)


def repeated_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line, times, chars: the most repeated long line (the earliest of equals) of texts that
    repetition dominates: eight times or more, and a quarter of the text in repeats."""
    rows = docs.select(key, F.length(text).alias("n"), F.posexplode(T.lines(F.col(text))).alias("pos", "line"))
    counts = rows.filter(F.length("line") >= 24).groupBy(key, "n", "line").agg(
        F.count("*").alias("times"), F.min("pos").alias("pos")
    )
    best = counts.filter("times >= 8").groupBy(key, "n").agg(
        F.min(F.struct((-F.col("times")).alias("less"), "pos", "line", "times")).alias("top"),
        F.sum((F.col("times") - 1) * F.length("line")).alias("chars"),
    )
    return best.filter("chars >= n div 4").select(key, "top.line", "top.times", "chars")
