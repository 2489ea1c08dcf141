"""Source divergence audit by systolic rotation.

Each (language, source) group has a vector: how often each of its language's
kept terms occurs in it.  All pairs of a language's groups are compared without
ever bringing all of them together.

1. Tasks count terms by group (a bounded table, emptied when full); terms in
   ``MIN_DOCS`` documents of the language are kept and numbered in term order.
2. Vectors are cut into shards by term, as many as the language's entries need,
   and packed: sorted numbers as deltas, counts, compressed.  Values are sums
   over terms, so shards are compared apart and their sums added.
3. A language's groups are dealt over about sqrt(groups) blocks.  Blocks stay
   resident in their partitions; in each round of a round-robin tournament the
   packed vectors of half of the blocks travel to their partners.  A meeting
   evaluates both directions of each pair.  A round's results are written, so a
   lost executor costs one round at most, and disk holds one round's vectors.
4. While at rest, each block ranks the terms of its groups in local heaps.

A cell of one language, shard and block is bounded by ``SHARD_ENTRIES``: neither
a source with a third of all rows nor a term in every document makes one larger.
All arithmetic is exact; sums that products could carry past 64 bits are divided
digit by digit.

Null texts, languages and sources count as empty strings, which are groups like
any other.  A group without terms has the vector of zeros.  Texts are read
whole; repeated rows count each time; equal values rank by item in UTF-8 order; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import nsmallest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.shared import stored

MIN_DOCS, SMOOTHING, UNIT, TOP_TERMS = 10, 2, 1_000_000_000, 10
#: Entries of a shard of a language on average, and terms that a comparison holds as a dense table.
SHARD_ENTRIES, DENSE = 1 << 16, 1 << 14
#: A task's counts are handed on when there are so many.
TALLIED = 400_000

#: A-Z to a-z, other letters and all bytes of non-ASCII characters to themselves, the rest to blanks.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

TALLY = "lang string, source string, term string, n bigint, docs bigint"
PACKED = "lang string, shard int, block int, source string, total bigint, kept bigint, lang_total bigint, vector binary"
FOUND = (
    "lang string, source string, item string, term_id bigint, value bigint, seen bigint, "
    "own_zero bigint, other_zero bigint, kept bigint"
)


def tally(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term by task and group; a row with the term '' for each group."""

    def table(counts: dict, documents: dict) -> pa.RecordBatch:
        rows = [(*g, t.decode("utf-8"), n, documents[g][t]) for g, c in counts.items() for t, n in c.items()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        names = [x.split()[0] for x in TALLY.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(Counter)
        documents: dict = defaultdict(Counter)
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, of = counts[lang, source], documents[lang, source]
                before = len(own)
                words = text.translate(LETTERS).split()
                own.update(words)
                of.update(set(words))
                own[b""] = of[b""] = 0
                held += len(own) - before
                if held >= TALLIED:
                    yield table(counts, documents)
                    counts.clear()
                    documents.clear()
                    held = 0
        yield table(counts, documents)

    whole = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(*whole, text).mapInArrow(run, TALLY)


def share(count: np.ndarray | int, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), by long division so that nothing passes 64 bits."""
    rest = np.asarray(count, np.int64) + SMOOTHING
    below = total + SMOOTHING * kept
    digits = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // below
        rest = rest % below
    return digits + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so squares fit."""
    return (p - q) ** 2 // (p + q)


def pack_vector(ids: np.ndarray, counts: np.ndarray, lang_counts: np.ndarray) -> bytes:
    order = np.argsort(ids)
    deltas = np.diff(ids[order], prepend=0)
    return zlib.compress(np.concatenate([deltas, counts[order], lang_counts[order]]).astype("<i8").tobytes(), 1)


def unpack_vector(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, counts, lang_counts = np.frombuffer(zlib.decompress(packed), "<i8").reshape(3, -1)
    return np.cumsum(ids), counts, lang_counts


def entries(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, kept terms, entries), each written.

    groups: lang, source.  kept: lang, term, term_id (in term order), lang_n.
    entries: lang, source, term_id, n, lang_n for each kept term that occurs in the group.
    """
    counts = stored(tally(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.filter(F.col("term") != "")
    by_term = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    ordered = by_term.filter(F.col("docs") >= MIN_DOCS).orderBy("lang", "term")
    kept = stored(ordered.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("term_id")))
    found = stored(terms.join(kept, ["lang", "term"]).select("lang", "source", "term_id", "n", "lang_n"))
    return counts.filter(F.col("term") == "").select("lang", "source"), kept, found


def vectors(groups: DataFrame, kept: DataFrame, found: DataFrame) -> DataFrame:
    """The packed vectors by language, shard and block, one of each group in each of its language's shards."""
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = stored(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "held"]))
    of_terms = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("held").alias("held"))
    langs = stored(
        langs.join(of_terms, "lang", "left").na.fill(0, ["kept", "lang_total"]).select(
            "lang", "kept", "lang_total",
            F.ceil(F.sqrt("sources")).cast("int").alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.col("held") / SHARD_ENTRIES)).cast("int").alias("shards"),
        )
    )
    shard = F.pmod(F.xxhash64("term_id"), F.col("shards")).cast("int")
    cut = found.join(langs.select("lang", "shards"), "lang").withColumn("shard", shard)
    cut = cut.groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("term_id", "n", "lang_n")).alias("entries"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    every = groups.join(langs, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    every = every.withColumn("block", block).join(cut, ["lang", "source", "shard"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        for batch in batches:
            lists = batch.column(7)
            flat = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            packed = [pack_vector(*(x[a:b] for x in flat)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(packed, pa.binary())], names)

    columns = ["lang", "shard", "block", "source", "total", "kept", "lang_total", "entries"]
    return stored(every.select(*columns).mapInArrow(run, PACKED)), stored(langs.select("lang", "blocks"))


class _Group:
    """A group's vector in one shard."""

    def __init__(self, row: dict):
        self.source, self.kept, self.lang_total = row["source"], row["kept"], row["lang_total"]
        self.ids, self.counts, self.lang_counts = unpack_vector(row["vector"])
        self.total = row["total"]
        self.zero = int(share(0, self.total, self.kept)) if self.kept else 1
        self.shares = share(self.counts, self.total, self.kept) if len(self.ids) else np.zeros(0, np.int64)

    def dense(self, ids: np.ndarray) -> np.ndarray:
        """The group's shares of the terms ``ids`` (sorted)."""
        out = np.full(len(ids), self.zero, np.int64)
        low, high = np.searchsorted(self.ids, [ids[0], ids[-1] + 1])
        out[np.searchsorted(ids, self.ids[low:high])] = self.shares[low:high]
        return out


def _groups(table: pa.Table) -> list[_Group]:
    return sorted(map(_Group, table.to_pylist()), key=lambda g: g.source)


def _meet(lang: str, resident: list[_Group], visitors: list[_Group] | None) -> list[tuple]:
    """Rows of FOUND for all pairs of ``resident`` and ``visitors`` (or within ``resident``), both directions."""
    n = len(resident)
    pairs = list(combinations(range(n), 2)) if visitors is None else [(a, n + b) for a in range(n) for b in range(len(visitors))]
    every = resident + (visitors or [])
    ids = np.unique(np.concatenate([g.ids for g in every])) if every else np.zeros(0, np.int64)
    sums = dict.fromkeys(pairs, 0)
    for at in range(0, len(ids), DENSE):
        shares = [g.dense(ids[at : at + DENSE]) for g in every]
        for a, b in pairs:
            sums[a, b] += int(gap(shares[a], shares[b]).sum())
    out = []
    for (a, b), value in sums.items():
        for x, y in ((every[a], every[b]), (every[b], every[a])):
            out.append((lang, x.source, y.source, None, value, len(ids), x.zero, y.zero, x.kept))
    return out


def _terms(lang: str, g: _Group) -> list[tuple]:
    """The group's first terms in this shard whose share is above the language's."""
    q = share(g.lang_counts, g.lang_total, g.kept)
    above = np.flatnonzero(g.shares > q)
    value = gap(g.shares[above], q[above])
    best = nsmallest(TOP_TERMS, zip((-value).tolist(), g.ids[above].tolist(), strict=True))
    return [(lang, g.source, None, i, -v, 0, 0, 0, 0) for v, i in best]


def _table(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64()] * 6
    columns = zip(*rows, strict=True) if rows else [()] * 9
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _at_rest(table: pa.Table) -> pa.Table:
    lang = table["lang"][0].as_py()
    groups = _groups(table)
    return _table(_meet(lang, groups, None) + [x for g in groups if len(g.ids) for x in _terms(lang, g)])


def _visited(resident: pa.Table, visitors: pa.Table) -> pa.Table:
    if not resident.num_rows or not visitors.num_rows:
        return _table([])
    return _table(_meet(resident["lang"][0].as_py(), _groups(resident), _groups(visitors)))


def partner(block: Column, round_: int, blocks: Column) -> Column:
    """Whom ``block`` meets in a round of the tournament of an even number of blocks (the last of an odd
    number's is missing): the others by the circle method, whoever would meet itself meets the last."""
    last = blocks + blocks % 2 - 1
    other = F.pmod(F.lit(round_) - block, last)
    of_last = F.pmod(F.lit(round_) * ((last + 1) / 2).cast("int"), last)
    return F.when(block == last, of_last).when(other == block, last).otherwise(other)


def rotate(packed: DataFrame, blocks: DataFrame) -> list[DataFrame]:
    """The written results of the blocks at rest and of each round."""
    keys = ["lang", "shard", "block"]
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    # A resident block stays where it is; what a lost executor held is read again from the written table.
    width = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resident = packed.repartition(width, *keys).persist()
    travelling = packed.join(blocks, "lang")
    try:
        out = [stored(resident.groupBy(*keys).applyInArrow(_at_rest, FOUND))]
        for r in range(most + most % 2 - 1 if most > 1 else 0):
            to = partner(F.col("block"), r, F.col("blocks"))
            # The lower block of a meeting is at home; languages of fewer rounds are done.
            moving = travelling.filter(F.lit(r) < F.col("blocks") + F.col("blocks") % 2 - 1).withColumn("to", to)
            moving = moving.filter((F.col("to") < F.col("block")) & (F.col("to") < F.col("blocks")))
            moving = moving.withColumn("block", F.col("to").cast("int")).select(*(F.col(c).alias(c) for c in packed.columns))
            met = resident.groupBy(*keys).cogroup(moving.groupBy(*keys)).applyInArrow(_visited, FOUND)
            out.append(stored(met))
        return out
    finally:
        resident.unpersist()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for the groups of ``docs`` (lang, source, text)."""
    groups, kept, found = entries(docs)
    packed, blocks = vectors(groups, kept, found)
    results = rotate(packed, blocks)
    met = results[0]
    for x in results[1:]:
        met = met.unionByName(x)
    # Terms that neither of two groups holds add the same value each.
    p, q = F.col("own_zero"), F.col("other_zero")
    unseen = (F.col("kept") - F.col("seen")) * F.expr("(own_zero - other_zero) * (own_zero - other_zero) div (own_zero + other_zero)")
    pairs = met.filter(F.col("item").isNotNull()).groupBy("lang", "source", "item", p, q, "kept")
    pairs = pairs.agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + unseen).alias("value"))
    by_id = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term_id")
    terms = met.filter(F.col("term_id").isNotNull()).withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= TOP_TERMS)
    terms = terms.join(kept.select("term_id", "term"), "term_id")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.unionByName(terms).withColumn("rank", F.row_number().over(ranked))
