"""Column functions over text.  Lengths and offsets are code points."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

# The patterns and thresholds of the text gate.
SECRET = (
    r"(?i)(?:sk-[A-Za-z0-9_-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|"
    r"(?:api[_-]?key|password|密码|密钥)[\"']?\s*[:=]\s*[\"']?[^\s\"']{8,}|"
    r"(?<![A-Za-z0-9_-])authorization[\"']?\s*:\s*[\"']?\s*bearer\s+[A-Za-z0-9._~+/-]{16,}={0,2})"
)
PERSONAL_DATA = (
    r"(?<!\p{Nd})(?:\+?86[- ]?)?1[3-9]\p{Nd}{9}(?!\p{Nd})|"
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|"
    r"(?<!\p{Nd})[1-9]\p{Nd}{5}(?:19|20)\p{Nd}{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\p{Nd}|3[01])\p{Nd}{3}[0-9Xx](?!\p{Nd})"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SHINGLE, NEAR_MIN_CHARS = 7, 300
CJK = r"[\x{4e00}-\x{9fff}]"
HAN = r"[\x{3400}-\x{9fff}]"
TRUNCATED = "…[truncated]"


@F.pandas_udf(S.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Runs of white space to one blank, ends stripped.  ASCII texts take the cheaper classes."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[ \t-\r]+", " "), "^ | $", "")
    return F.when(is_ascii(text), plain).otherwise(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""))


def comparison_text(text: Column) -> Column:
    """What exact comparison sees: composed, white space folded; numbers and punctuation stay.
    Only texts beyond ASCII leave the JVM."""
    return squash(F.when(is_ascii(text), text).otherwise(nfc(F.when(~is_ascii(text), text))))


def text_issue(text: Column) -> Column:
    """The first gate that a text fails, or null."""
    return (
        F.when(text.isNull() | (strip(text) == ""), "empty_text")
        .when(text.contains("�") | text.contains("\0"), "invalid_encoding")
        .when(text.rlike(SECRET), "potential_secret")
        .when(text.rlike(PERSONAL_DATA), "potential_personal_data")
    )


def structure_sensitive(text: Column) -> Column:
    """Code, tables and equations, where a tiny edit is a different text."""
    marks = [text.contains(m) for m in ("```", "\t", "{", "}", "==", "=", "->", "\n|")]
    found = text.rlike(r"(?m)^\s*(?:def|class|function|import|from)\s+\w+")
    for m in marks:
        found = found | m
    return found


_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` characters."""
    x = _points(text).astype(np.uint64)
    n = len(x) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = x[:n]
    for k in range(1, size):
        h = ((h ^ (h >> np.uint64(29))) * _MIX) + x[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * _SPREAD
    return np.unique(h ^ (h >> np.uint64(29)))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def shingle_checksums(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted CRC-32 values of the UTF-8 bytes of the distinct runs of ``size`` characters, a column of
    bytes at a time."""
    x = _points(text)
    n = len(x) - size + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    wide = 1 + (x >= 0x80) + (x >= 0x800).astype(int) + (x >= 0x10000)
    columns = []
    for k in range(int(wide.max())):
        shift = (6 * (wide - 1 - k)).clip(0).astype(np.uint32)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[wide] | (x >> shift)
        byte = np.where(wide == 1, x, lead) if k == 0 else 0x80 | (x >> shift & 0x3F)
        columns.append((byte.astype(np.uint32), wide > k))
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    for j in range(size):
        for byte, there in columns:
            new = _CRC[(crc ^ byte[j : j + n]) & 0xFF] ^ (crc >> np.uint32(8))
            crc = new if len(columns) == 1 else np.where(there[j : j + n], new, crc)
    return np.unique(crc ^ np.uint32(0xFFFFFFFF))


@F.pandas_udf(S.LongType())
def shingle_count(texts: pd.Series) -> pd.Series:
    """The number of distinct runs of seven characters; null for null."""
    return pd.Series([None if t is None else len(shingle_hashes(t)) for t in texts], dtype="Int64")


@F.pandas_udf(S.BinaryType())
def shingle_set(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else shingle_hashes(t).tobytes())


@F.pandas_udf(S.DoubleType())
def set_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of two sets of ``shingle_set``."""

    def one(x: bytes, y: bytes) -> float:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common / (len(x) + len(y) - common)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(S.ArrayType(S.LongType()))
def bottom_checksums(texts: pd.Series) -> pd.Series:
    """The twelve least checksums of the shingles; null for null."""
    return texts.map(lambda t: None if t is None else shingle_checksums(t)[:12].astype(np.int64).tolist())


def lines(text: Column) -> Column:
    """Stripped non-blank lines."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def language_share(text: Column) -> Column:
    """zh, en, mixed or other, by the share of Han among Han and Latin letters."""
    han, latin = F.regexp_count(text, F.lit(HAN)), F.regexp_count(text, F.lit("[A-Za-z]"))
    share = F.try_divide(han, han + latin)
    return F.when(share.isNull(), "other").when(share.between(0.2, 0.8), "mixed").when(share > 0.8, "zh").otherwise("en")


def detect_language(text: Column) -> Column:
    share = F.try_divide(F.regexp_count(text, F.lit(CJK)), F.length(text))
    return F.when(F.coalesce(share, F.lit(0.0)) > 0.15, "zh").otherwise("en")


def presence_language(text: Column) -> Column:
    """mixed, zh or en_or_other, by which scripts occur at all."""
    zh, en = text.rlike(CJK), text.rlike("[A-Za-z]")
    return F.when(zh & en, "mixed").when(zh, "zh").otherwise("en_or_other")


def estimate_tokens(text: Column) -> Column:
    """CJK characters plus 1.3 for each other word, rounded down."""
    cjk = F.regexp_count(text, F.lit(CJK))
    words = F.regexp_count(F.regexp_replace(text, CJK, " "), F.lit(r"(?U)\S+"))
    return F.floor(cjk + 1.3 * words)


def truncated(text: Column, limit: int = 8000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


@F.pandas_udf(S.StringType())
def truncate_to_tokens(texts: pd.Series, budgets: pd.Series) -> pd.Series:
    """The longest prefix within a token budget, marked when it is cut."""
    import re
    from itertools import islice

    def tokens(t: str) -> int:
        cjk = len(re.findall("[一-鿿]", t))
        return int(cjk + 1.3 * len(re.sub("[一-鿿]", " ", t).split()))

    def cut(t: str | None, budget: int) -> str | None:
        if t is None or tokens(t) <= budget:
            return t
        mark = "…[截断]"
        # A word or Chinese character costs one token at least: what lies beyond so many is never looked at again.
        first = list(islice(re.finditer(r"[一-鿿]|[^\s一-鿿]+", t), budget + 1))
        low, high = 0, first[-1].end() if first else len(t)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if tokens(t[:mid] + mark) <= budget else (low, mid - 1)
        return t[:low] + mark

    return pd.Series([cut(t, int(b)) for t, b in zip(texts, budgets, strict=True)])


def strip_tags(html: Column) -> Column:
    """Tags to blanks, white space folded."""
    return squash(F.regexp_replace(html, "<[^>]*>", " "))


@F.pandas_udf(S.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references resolved, once; only texts with an ampersand come here."""
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def plain_text(html: Column, most: int | None = None) -> Column:
    """Tags to blanks, character references resolved, white space folded, cut to ``most`` characters."""
    bare = F.regexp_replace(html, "<[^>]*>", " ")
    said = F.when(bare.contains("&"), unescaped(F.when(bare.contains("&"), bare))).otherwise(bare)
    return squash(said) if most is None else F.substring(squash(said), 1, most)


def chunk_id(text: Column) -> Column:
    """Sixteen hex digits of the text without white space."""
    return F.substring(F.sha2(F.regexp_replace(text, r"(?U)\s+", ""), 256), 1, 16)


def normalize_plain(text: Column) -> Column:
    """Lines of white space emptied, three line ends or more to two, none at the ends; indentation stays."""
    rows = F.transform(F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK), lambda x: F.when(x.rlike(r"(?U)\S"), x).otherwise(""))
    return F.regexp_replace(F.regexp_replace(F.array_join(rows, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def length_bin(n: Column) -> Column:
    return (
        F.when(n <= 200, "0-200").when(n <= 1000, "201-1000").when(n <= 4000, "1001-4000")
        .when(n <= 16000, "4001-16000").otherwise("16001+")
    )


def turn_bin(n: Column) -> Column:
    return F.when(n <= 2, n.cast("string")).when(n <= 5, "3-5").otherwise("6+")


def search_tokens(text: Column) -> Column:
    """Distinct lower-case words and, of Chinese runs, bigrams (single characters alone)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9_]+|{CJK}+"), F.lit(0))

    def pieces(run: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike("^[a-z0-9_]") | (F.length(run) == 1), F.array(run)).otherwise(two)

    return F.array_distinct(F.flatten(F.transform(runs, pieces)))
