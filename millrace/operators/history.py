"""Lexical likeness of questions over an index of sampled terms.

A question's terms are its words, pairs of neighbouring words and runs of two and
three Han characters.  The index keeps the ``TERMS`` terms that come first in the
order of a hash, so that a long question is sampled throughout, not by its
beginning.  A search takes the rarest terms, the latest questions that hold each
and the candidates with most hits, by documented limits, then ranks by Dice.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from millrace.functions import text as T
from millrace.operators.storage import stored

# The patterns of words, Han runs and numbers, and the limits of the index and of a search.
WORD = r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)*"
HAN_RUN = r"[㐀-鿿]+"
NUMERAL = r"(?U)[-+]?\d+(?:\.\d+)?(?:[%％])?"
TERMS, RAREST, POSTINGS, CANDIDATES = 48, 12, 64, 256


@F.pandas_udf(S.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Compatibility-composed and case-folded; only texts beyond ASCII come here."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalised(text: Column) -> Column:
    """What is compared: folded, blanks squeezed, without question marks at its end."""
    plain = F.when(T.is_ascii(text), F.lower(text)).otherwise(folded(F.when(~T.is_ascii(text), text)))
    return F.regexp_replace(T.squash(plain), "[?？ ]+$", "")


def exact(text: Column, strip: bool = False) -> Column:
    """What an identity keeps: composed, line ends as line feeds; case and inner blanks stay.  Null is empty."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    text = F.when(T.is_ascii(text), text).otherwise(T.nfc(F.when(~T.is_ascii(text), text)))
    return T.strip(text) if strip else text


def _sealed(parts: list[Column]) -> Column:
    return F.sha2(F.to_json(F.array(*parts)), 256)


def _dimension(value: Column, fallback: str) -> Column:
    return normalised(F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback)))


def contract_identity(question: Column, context: Column, policy: Column, kind: Column) -> Column:
    """Question, visible context, answer policy and kind as one digest."""
    return _sealed([exact(question, True), exact(context), _dimension(policy, "answer"), _dimension(kind, "closed_book")])


def learner_task_identity(question: Column, context: Column) -> Column:
    """What the learner sees, whatever the policy or kind behind it."""
    return _sealed([exact(question, True), exact(context)])


def actual_input_identity(contract: Column, actual: Column, only: Column) -> Column:
    """A contract with the digest of the input that was really sent, or that digest alone; the contract where
    there is none.  A digest is 64 hex digits; anything else is an error."""
    good = actual.isNull() | actual.rlike("^[a-f0-9]{64}$")
    checked = F.when(good, actual).otherwise(F.raise_error(F.lit("qa_history_actual_input_hash_invalid")).cast("string"))
    alone = _sealed([F.lit("actual_training_input_v1"), checked])
    return F.when(actual.isNull(), contract).when(only, alone).otherwise(_sealed([contract, checked]))


def terms(norm: Column) -> Column:
    """The distinct terms of a normalised question: w: words and pairs, c: Han runs."""
    words = F.regexp_extract_all(norm, F.lit(WORD), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("w:"), a, F.lit(" "), b))
    runs = F.regexp_extract_all(norm, F.lit(HAN_RUN), F.lit(0))

    def grams(run: Column, width: int) -> Column:
        last = F.length(run) - width + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.lit("c:"), F.substr(run, i, F.lit(width))))

    single = F.transform(F.filter(runs, lambda r: F.length(r) == 1), lambda r: F.concat(F.lit("c:"), r))
    han = [F.flatten(F.transform(runs, lambda r: grams(r, 2))), F.flatten(F.transform(runs, lambda r: grams(r, 3)))]
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), pairs, single, *han))


def term_hash(term: str) -> bytes:
    """The order of the sample."""
    return hashlib.blake2b(term.encode(), digest_size=8).digest()


def sampled(rows: DataFrame, column: str = "terms", k: int = TERMS) -> DataFrame:
    """``rows`` with the k terms of least hash of ``column``, equal hashes by term."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [heapq.nsmallest(k, ts, key=lambda t: (term_hash(t), t)) for ts in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(least, pa.list_(pa.string())))

    return rows.mapInArrow(run, rows.schema)


def least(terms: Column, hashed: Callable[[Column], Column], k: int = TERMS) -> Column:
    """The sample of one row's ``terms`` (an array): structs of hash and term.  What it leaves out is in no sample of
    a key that has this row."""
    both = F.transform(F.array_distinct(terms), lambda t: F.struct(hashed(t).alias("hash"), t.alias("term")))
    return F.slice(F.array_sort(both), 1, k)


def bottom(rows: DataFrame, key: str, term: str, hashed: str, k: int = TERMS) -> DataFrame:
    """key, term, place: the same sample where a key's terms are rows.  Each task ranks what it holds first
    (Spark's limit below the window), so that k rows of a key leave it at most.  Where a row holds many terms,
    ``least`` takes its sample before they become rows."""
    w = Window.partitionBy(key).orderBy(hashed, term)
    placed = rows.select(key, term, hashed).withColumn("place", F.dense_rank().over(w)).filter(F.col("place") <= k)
    return placed.select(key, term, "place").distinct()  # within the window's partitions


def index(questions: DataFrame, key: str = "row_id", text: str = "question") -> DataFrame:
    """key, terms (the sample), numbers: one row for each question."""
    norm = F.coalesce(normalised(F.col(text)), F.lit(""))
    df = questions.select(key, norm.alias("_norm"))
    numbers = F.regexp_extract_all("_norm", F.lit(NUMERAL), F.lit(0))
    return sampled(df.select(key, terms(F.col("_norm")).alias("terms"), numbers.alias("numbers")))


def similar(indexed: DataFrame, queries: DataFrame, limit: int = 10, key: str = "row_id") -> DataFrame:
    """query, key, score, same_numbers, rank: the ``limit`` most alike questions of ``indexed`` for each of
    ``queries`` (both as ``index`` gives them); ties by key.  A question does not find itself only if it is
    not indexed.

    The limits are the search's own: ``RAREST`` terms of a query, ``POSTINGS`` latest questions of a term and
    ``CANDIDATES`` of a query.  A common term's postings are cut within each task before they are ranked.
    """
    indexed = stored(indexed)
    postings = stored(indexed.select(key, F.explode("terms").alias("term")))
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("total")))
    asked = stored(queries.select(F.col(key).alias("query"), F.col("terms").alias("asked"), F.col("numbers").alias("asked_numbers")))
    rare = asked.select("query", F.explode("asked").alias("term")).join(counts, "term")
    by_rarity = Window.partitionBy("query").orderBy("total", "term")
    rare = rare.withColumn("_at", F.row_number().over(by_rarity)).filter(F.col("_at") <= RAREST).select("query", "term")
    latest = Window.partitionBy("term").orderBy(F.desc(key))
    held = postings.withColumn("_at", F.row_number().over(latest)).filter(F.col("_at") <= POSTINGS).select("term", key)
    hits = rare.join(held, "term").groupBy("query", key).agg(F.count("*").alias("hits"))
    most = Window.partitionBy("query").orderBy(F.desc("hits"), F.desc(key))
    found = hits.withColumn("_at", F.row_number().over(most)).filter(F.col("_at") <= CANDIDATES).select("query", key)
    both = found.join(asked, "query").join(indexed, key)
    common = F.size(F.array_intersect("asked", "terms"))
    score = F.round(2 * common / (F.size("asked") + F.size("terms")), 6)
    scored = both.select("query", key, score.alias("score"), (F.col("asked_numbers") == F.col("numbers")).alias("same_numbers"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
