"""The distribution of training records: mergeable partial counts, and a report over targets.

A record is its target, a text or messages, and flags.  Ten measures are counted:
rows, characters of the body and of reasoning, rows with reasoning, with images,
with tools, and histograms of languages (of the body and of the user), turns and
lengths (of body and reasoning).  Every measure is a sum, so partial counts of
shards, targets or runs merge by adding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources import changed_files

MESSAGES = "array<struct<role:string,content:string,reasoning:string,tool_calls:int,images:int>>"
RECORD = f"target string, text string, messages {MESSAGES}, reasoning string, images boolean, tools boolean"

# The bins of lengths and turns, the classes of language, the target that no total counts.
LENGTHS = {"0–200": 200, "201–1,000": 1000, "1,001–4,000": 4000, "4,001–16,000": 16000, "16,001+": None}
TURNS = {"0": (0, 0), "1": (1, 1), "2": (2, 2), "3–5": (3, 5), "6+": (6, None)}
LANGUAGES = ("zh", "en", "mixed", "other")
NOT_IN_TOTAL = "agent_negative"

SUMS = ("rows", "body_chars", "reasoning_chars", "reasoning_rows", "image_rows", "tool_rows")
HISTOGRAMS = {
    "languages": LANGUAGES, "user_languages": (*LANGUAGES, "none"), "turns": tuple(TURNS), "lengths": tuple(LENGTHS),
    "reasoning_lengths": tuple(LENGTHS),
}


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(of(m), F.lit(0)))


def _length_bin(n: Column) -> Column:
    out = F.lit(list(LENGTHS)[-1])
    for name, most in reversed([x for x in LENGTHS.items() if x[1] is not None]):
        out = F.when(n <= most, name).otherwise(out)
    return out


def features(records: DataFrame) -> DataFrame:
    """``records`` (``RECORD``) with what each is measured by.  Null texts and messages count as absent."""
    ms = F.coalesce("messages", F.array().cast(MESSAGES))
    by = lambda *roles: F.filter(ms, lambda m: m["role"].isin(*roles))
    said, users, answers = by("user", "assistant"), by("user"), by("assistant")
    letters = lambda xs, pattern: _total(xs, lambda m: F.regexp_count(m["content"], F.lit(pattern)))
    own = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0))

    def language(han: Column, latin: Column) -> Column:
        share = F.try_divide(han, han + latin)
        return F.when(share.isNull(), "other").when(share.between(0.2, 0.8), "mixed").when(share > 0.8, "zh").otherwise("en")

    latin = "[A-Za-z]"
    thought = F.coalesce(F.length("reasoning"), F.lit(0)) + _total(answers, lambda m: F.length(m["reasoning"]))
    turns = F.size(users)
    turn_bin = F.lit("6+")
    for name, (_, most) in reversed(list(TURNS.items())[:-1]):
        turn_bin = F.when(turns <= most, name).otherwise(turn_bin)
    return records.withColumns(
        {
            "body_chars": F.coalesce(F.length("text"), F.lit(0)) + _total(said, lambda m: F.length(m["content"])),
            "reasoning_chars": thought,
            "languages": language(letters(said, T.HAN) + own(T.HAN), letters(said, latin) + own(latin)),
            "user_languages": F.when(F.exists(users, lambda m: m["content"].isNotNull()), language(letters(users, T.HAN), letters(users, latin))).otherwise("none"),
            "turns": turn_bin,
            "has_images": F.coalesce("images", F.lit(False)) | F.exists(ms, lambda m: F.coalesce(m["images"], F.lit(0)) > 0),
            "has_tools": F.coalesce("tools", F.lit(False)) | F.exists(ms, lambda m: (F.coalesce(m["tool_calls"], F.lit(0)) > 0) | F.coalesce(m["role"].isin("tool", "function"), F.lit(False))),
        }
    )


def measures() -> list[str]:
    """The names of the partial counts."""
    return [*SUMS, *(f"{h}: {b}" for h, bins in HISTOGRAMS.items() for b in bins)]


def partials(records: DataFrame, *by: str) -> DataFrame:
    """by, and the partial counts of their records."""
    df = features(records).withColumns({"lengths": _length_bin(F.col("body_chars")), "reasoning_lengths": F.when(F.col("reasoning_chars") > 0, _length_bin(F.col("reasoning_chars")))})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = [F.count("*"), total("body_chars"), total("reasoning_chars"), F.count_if(F.col("reasoning_chars") > 0), F.count_if("has_images"), F.count_if("has_tools")]
    counts = [F.count_if(F.col(h) == b) for h, bins in HISTOGRAMS.items() for b in bins]
    return df.groupBy(*by).agg(*(c.cast("bigint").alias(n) for c, n in zip(sums + counts, measures(), strict=True)))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Partial counts added up by coarser groups."""
    return parts.groupBy(*by).agg(*(F.sum(F.col(f"`{m}`")).cast("bigint").alias(m) for m in measures()))


def report(parts: DataFrame) -> DataFrame:
    """A row for each target and one for 'total', which leaves ``NOT_IN_TOTAL`` out: the sums, and each
    histogram as a map of its bins, zeros too."""
    targets = merged(parts, "target")
    whole = merged(parts.filter(F.col("target") != NOT_IN_TOTAL).withColumn("target", F.lit("total")), "target")
    bins = [F.create_map(*(x for b in bins for x in (F.lit(b), F.col(f"`{h}: {b}`")))).alias(h) for h, bins in HISTOGRAMS.items()]
    return targets.unionByName(whole).select("target", *SUMS, *bins)


def cached(spark: SparkSession, path: str, cache: str, read, pattern: str = "*") -> tuple[DataFrame, changed_files.Refreshed]:
    """(report, what was read) over the files under ``path``; only files of unknown signature are read.
    ``read(paths)`` gives their records with a column ``file``."""
    schema = "file string, target string, " + ", ".join(f"`{m}` bigint" for m in measures())
    got = changed_files.refresh(spark, path, cache, lambda paths: partials(read(paths), "file", "target"), schema, pattern)
    return report(got.rows), got
