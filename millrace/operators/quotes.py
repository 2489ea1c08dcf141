"""Quotes bound to their places in a source: exactly, or but for white space where extraction put it in."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

SPAN = S.StructType(
    [S.StructField("quote_index", S.IntegerType()), S.StructField("start", S.LongType()), S.StructField("end", S.LongType()),
     S.StructField("source_quote", S.StringType()), S.StructField("match", S.StringType())]
)


def bound(source: str | None, quotes: list[str] | None, folded: bool) -> list[dict] | None:
    """The first place of each quote, by code points; None if one is blank or has none."""
    if source is None or not len(quotes if quotes is not None else []) or any(q is None or not q.strip() for q in quotes):
        return None
    out: list[dict] = []
    dense, ends = None, []
    for i, quote in enumerate(quotes):
        at, match = source.find(quote), "exact"
        end = at + len(quote)
        if at < 0:
            if not folded:
                return None
            if dense is None:
                # Where each word ends among the characters that are no white space, and how far it is moved.
                words, n, place = [], 0, 0
                for word in source.split():
                    place = source.index(word, place)
                    words.append(word)
                    ends.append((n + len(word), place - n))
                    n, place = n + len(word), place + len(word)
                dense = "".join(words)
            needle = "".join(quote.split())
            found = dense.find(needle)
            if found < 0:
                return None
            moved = lambda k: k + ends[bisect_left(ends, (k + 1, -1))][1]
            at, end, match = moved(found), moved(found + len(needle) - 1) + 1, "pdf_whitespace"
        out.append({"quote_index": i, "start": at, "end": end, "source_quote": source[at:end], "match": match})
    return out


@F.pandas_udf(S.ArrayType(SPAN))
def _spans(sources: pd.Series, quotes: pd.Series, folded: pd.Series) -> pd.Series:
    return pd.Series([bound(s, q, bool(f)) for s, q, f in zip(sources, quotes, folded, strict=True)])


def quote_spans(source: Column, quotes: Column, pdf_whitespace: Column | bool = False) -> Column:
    """array<struct<quote_index,start,end,source_quote,match>>, or null where a quote is not in the source.
    White space is disregarded only where ``pdf_whitespace`` holds, and only if the exact quote is absent."""
    folded = F.lit(pdf_whitespace) if isinstance(pdf_whitespace, bool) else F.coalesce(pdf_whitespace, F.lit(False))
    return _spans(source, quotes, folded)
