"""Importance resampling of documents by hashed n-gram models.

Two generative models over ``BUCKETS`` hashed unigrams and bigrams (a text's
start and end count as tokens) are counted: one of the target (a bounded sample
of rows labelled good) and one of the raw corpus (every document).  A document's
log weight is its mean log-ratio of target to raw times its number of n-grams,
``EVIDENCE`` at most, because n-grams of a long text are not independent.

Sampling.  The inverse temperature and the prior are those of a logistic fit of
the labelled sample to the log weights, so tempered weights are odds of being
good.  Each document's tempered weight is perturbed by Gumbel noise and the k
largest keys stay: a sample without replacement, in proportion to the weights.
k is a parameter; by default it is the expected number of good documents (the
sum of their probabilities) and ``MARGIN`` of all documents, in favour of
keeping.  Noise is a hash of the seed, the id and the text.

Counting is a pass with a fixed-size result (buckets); scoring is a second pass
that writes one row for each document to the shared checkpoint folder.  The k-th
largest key is found by counting fixed-size histograms of ever narrower ranges,
so no sort gathers the documents.

Null texts count as empty; a text of any length is counted whole.  Null ids are
carried along.  Repeated rows get equal keys, and equal keys at the boundary are
kept together.  Without labelled good rows, and of an empty table, all documents
are kept; other columns pass through ``keep`` and are ignored by ``select``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored
from millrace.llm.training import MAX_LABELLED, labelled_sample

BUCKETS = 1 << 14
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: N-grams of evidence that a document's mean ratio counts for at most.
EVIDENCE = 100
#: Share of all documents that is kept beyond the expected number of good ones.
MARGIN = 0.01
SMOOTHING = 1.0
BINS = 4096
#: Tokens a worker remembers; executors run several workers beside the JVM's heap.
MEMO = 1 << 17
_PAIR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Tokens(dict):
    """token -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


def features(text: str, memo: Tokens) -> np.ndarray:
    """Bucket numbers of the unigrams and bigrams of a text; never empty."""
    tokens = TOKEN.findall(text)
    own = np.fromiter(map(memo.__getitem__, ["\0start", *tokens, "\0end"]), np.uint64, len(tokens) + 2)
    pairs = (own[:-1] * _PAIR) ^ (own[1:] >> np.uint64(7))
    every = np.concatenate([own[1:-1], pairs * _SPREAD])
    return (every >> np.uint64(11)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """Log target over raw by bucket; probability of good = logistic(slope * log weight + prior)."""

    ratio: np.ndarray
    slope: float
    prior: float

    def log_weight(self, text: str, memo: Tokens) -> float:
        found = self.ratio[features(text, memo)]
        return float(found.mean()) * min(len(found), EVIDENCE)


def _counts(df: DataFrame) -> np.ndarray:
    """Bucket counts over all rows of ``df`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, n = Tokens(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                n += np.bincount(features(t.as_py() or "", memo), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    rows = df.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in rows.collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log of target over raw of two count vectors, smoothed."""
    share = lambda n: (n + SMOOTHING) / (n.sum() + SMOOTHING * len(n))
    return np.log(share(target) / share(raw))


def calibrate(weights: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, prior) of a ridge logistic fit by Newton's method; (1, 0) if one class is missing."""
    if good.all() or not good.any():
        return 1.0, 0.0
    x = np.stack([weights, np.ones(len(weights))], 1)
    w, ridge = np.zeros(2), np.array([1e-2, 1e-9])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (good - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w += np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    """The models of target and raw text and the temperature; None without rows labelled good."""
    sample = stored(labelled_sample(docs, labels, "quality", limit))
    target = _counts(sample.filter("quality = 1"))
    if not target.sum():
        return None
    ratio = log_ratios(target, _counts(docs))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, own = Tokens(), Model(sent.value, 1.0, 0.0)
        for b in batches:
            weights = [own.log_weight(t.as_py() or "", memo) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(weights, pa.float64()), b.column(1).cast(pa.int32())], ["weight", "quality"])

    rows = sample.select("text", "quality").mapInArrow(run, "weight double, quality int").collect()  # ``limit`` rows at most
    rows.sort(key=lambda r: (r["weight"], r["quality"]))
    return Model(ratio, *calibrate(np.array([r["weight"] for r in rows]), np.array([r["quality"] == 1 for r in rows], float)))


def gumbel(seed: int, key: int | None, text: str) -> float:
    """Standard Gumbel noise, a hash of seed, id and text."""
    own = xxhash.xxh3_64_intdigest(struct.pack("<qqQ", seed, key or 0, xxhash.xxh3_64_intdigest(text)))
    return -float(np.log(-np.log(((own >> 11) + 0.5) / 2**53)))


def score(docs: DataFrame, model: Model, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (doc_id alone by default) with log_weight and gumbel_key of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = columns or ["doc_id"]
    rows = docs.select(*columns, F.col("doc_id").alias("_id"), F.col("text").alias("_body"))
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, own = Tokens(), sent.value
        for b in batches:
            weights, keys = [], []
            for key, text in zip(b.column(n).to_pylist(), b.column(n + 1), strict=True):
                body = text.as_py() or ""
                weights.append(own.log_weight(body, memo))
                keys.append(own.slope * weights[-1] + gumbel(seed, key, body))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array(weights, pa.float64()), pa.array(keys, pa.float64())], [*columns, "log_weight", "gumbel_key"]
            )

    schema = rows.select(*columns).schema.add("log_weight", "double").add("gumbel_key", "double")
    return rows.mapInArrow(run, schema)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, from histograms of ``BINS`` bins over ever narrower ranges."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / BINS
        if low + width == low or high - width == high:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        within = df.filter(F.col(column).between(low, high))
        stats = within.groupBy(bin_.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for r in sorted(stats.collect(), key=lambda r: -r["bin"]):  # BINS rows at most
            if r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def sampled(scored: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """``scored`` (a stored table) with kept: the k largest keys."""
    good = 1 / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -(model.slope * F.col("log_weight") + model.prior)))))
    n, expected = scored.agg(F.count("*"), F.sum(good)).first()
    if k is None:
        k = min(n, round((expected or 0.0) + MARGIN * n))
    cut = -np.inf if k >= n else np.inf if k <= 0 else kth_largest(scored, "gumbel_key", k)
    return scored.withColumn("kept", F.col("gumbel_key") >= float(cut))


def select(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, k: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept of every document."""
    model = fit(docs, labels, limit)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("gumbel_key"), F.lit(True).alias("kept"))
    return sampled(stored(score(docs, model, seed)), model, k)


def keep(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, k: int | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.  Rows are written beside their
    keys, so no text is shuffled or tokenized again."""
    model = fit(docs, labels, limit)
    if model is None:
        return docs
    # Numbered names, so that no column of ``docs`` clashes with the keys.
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.select("*", F.col("doc_id").alias("__id"), F.col("text").alias("__text")).toDF(*names, "doc_id", "text")
    rows = sampled(stored(score(held, model, seed, names)), model, k)
    return rows.filter("kept").select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])
