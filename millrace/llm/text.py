"""Native (JVM-side) text expressions that several operators share.

Everything here is built from ``pyspark.sql.functions``; no Python runs on the
executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that ends a word: space and U+0009 to U+000D.
BLANK = r"[ \x09-\x0D]"


def whole(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  Pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def split_words(text: Column, separator: str) -> Column:
    """The non-empty pieces between runs of ``separator``."""
    return F.array_remove(F.split(text, f"{separator}+"), "")


def matches(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<kind,start,end,hit>> of the leftmost non-overlapping matches.

    Offsets are code points, the end exclusive.  ``split`` gives what lies
    between matches and ``regexp_extract_all`` the matches; a running sum of
    both lengths gives the places.  Rows without a match (nearly all) only pay
    for one scan.
    """
    kinds = "array<struct<kind:string,start:bigint,end:bigint,hit:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        grown = F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one)))
        return F.struct(end.alias("at"), grown.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kinds).alias("out"))
    spans = F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(
        F.array().cast(kinds)
    )
    return F.filter(spans, lambda s: keep(s["hit"])) if keep else spans


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )
