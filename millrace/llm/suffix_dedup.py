"""Removal of repeated 200-byte strings, by sharded suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else, in any document, goes.  Matches never cross documents.

1. Anchors.  Each window of ``LENGTH`` bytes names its least hashed
   ``GRAM``-gram.  Equal windows name equal anchors, so a repeat always meets
   itself under one anchor.  Consecutive windows with the same anchor form a
   run (151 windows, 350 bytes at most) of a document.
2. Anchors seen once are dropped.  Runs of equal bytes are one context with a
   count; an anchor with a single context needs no comparison.
3. Contexts are dealt to shards by anchor.  Where an anchor has more than
   ``HOT`` contexts (a common line in many surroundings) their windows are dealt
   by longer strings instead: a core that ``STRIDE`` neighbouring windows share.
   Equal pieces of a shard are one piece with a weight.  A shard's pieces are
   concatenated, a suffix array is induced and its permuted common prefixes
   computed; neighbours that share ``LENGTH`` bytes are repeats of each other.
   A shard that still has more than ``HOT`` different pieces (a line's edge) is
   dealt a last time, each window by all of its bytes; such shards hold equal
   windows alone, so their weights decide.  No task holds more than ``HOT``
   pieces of a shard, and every window meets its equals at every step.
4. Covered windows return to all contexts of their piece, from there to all runs
   and documents, and the bytes left are cut out.

Counts reduce map-side; joins are equi-joins on anchors, contexts or documents
that adaptive execution can split.  Documents are addressed by a 64-bit hash of
id and text; rows that repeat are copies of each other.  Intermediate tables go
to the shared folder.  Null and empty texts have no bytes; texts under
``LENGTH`` bytes keep all of theirs; long texts are hashed in overlapping
stretches.  Null ids are ids like others; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored
from millrace.llm.suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 200, 50
WINDOWS = LENGTH - GRAM + 1
HOT, STRIDE = 2_000, 16
#: Bytes hashed at a time; a longer document is taken in overlapping stretches.
STRETCH = 1 << 19
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1 << 21
_PLACE_BITS = np.uint64(20)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes, from hashes of powers of two."""
    n = len(x) - GRAM + 1
    cur, out, off = (x.astype(np.uint64) + np.uint64(1)) * _A, None, 0
    for bit in range(GRAM.bit_length()):
        if GRAM >> bit & 1:
            part = cur[off : off + n]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * _B + part
            off += 1 << bit
        m = 1 << bit
        cur = (cur[:-m] ^ (cur[:-m] >> np.uint64(31))) * _A + cur[m:] if len(cur) > m else cur[:0]
    return (out ^ (out >> np.uint64(32))) * _A


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from block-wise prefix and suffix minima."""
    n = len(h)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def runs(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows, anchor's place after the first window) of the runs in the
    concatenated texts ``x``, which end at ``ends``."""
    if len(x) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = gram_hashes(x)
    place = np.arange(len(h), dtype=np.uint64)
    low = _window_min((h & ~np.uint64((1 << 20) - 1)) | place, WINDOWS)  # ties: the leftmost place
    own = ends[np.searchsorted(ends, np.arange(len(low)), "right")]  # the end of each window's text
    valid = np.arange(len(low)) + LENGTH <= own
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1])]) & valid
    stop = np.concatenate([new[1:] | ~valid[1:], [True]]) & valid
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    anchor = (low[first] >> _PLACE_BITS).astype(np.int64)
    return anchor, first, last - first + 1, (low[first] & np.uint64((1 << 20) - 1)).astype(np.int64) - first


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _address(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("key"), body.alias("body")).select(
        "key", F.xxhash64("key", "body").alias("doc"), "body"
    )


def _stretches(bodies: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(documents, offsets in them, bytes, ends): texts together up to STRETCH bytes."""
    who: list[int] = []
    offs: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, body in enumerate(bodies):
        if len(body) < LENGTH:
            continue
        for at in range(0, len(body) - LENGTH + 1, STRETCH):
            part = body[at : at + STRETCH + LENGTH - 1]
            if parts and held + len(part) > STRETCH + LENGTH:
                yield who, offs, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                who, offs, parts, held = [], [], [], 0
            who.append(i)
            offs.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield who, offs, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def anchors(addressed: DataFrame) -> DataFrame:
    """anchor, context (a hash of the run's bytes), doc, at, windows, off of every run."""
    names = ["anchor", "context", "doc", "at", "windows", "off"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy()
            for who, offs, x, ends in _stretches(b.column(1).to_pylist()):
                anchor, first, windows, off = runs(x, ends)
                text = np.searchsorted(ends, first, "right")
                begins = np.concatenate([[0], ends[:-1]])
                view = memoryview(x)
                context = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[a : a + n + LENGTH - 1]) for a, n in zip(first.tolist(), windows.tolist(), strict=True)),
                    np.uint64, len(first),
                )
                columns = [
                    pa.array(anchor), pa.array(context.view(np.int64)), pa.array(docs[np.array(who)[text]]),
                    pa.array(first - begins[text] + np.array(offs)[text]),
                    pa.array(windows.astype(np.int16)), pa.array(off.astype(np.int16)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return addressed.select("doc", "body").mapInArrow(
        run, "anchor bigint, context bigint, doc bigint, at bigint, windows smallint, off smallint"
    )


def _cut(texts: DataFrame) -> DataFrame:
    """shard, piece (a hash of the bytes), anchor, context, copies, base, windows, bytes of what is to be
    compared; ``texts`` has ``wanted``, the contexts to be cut from each body.  ``base`` is the first
    window's number within the context."""
    schema = "shard bigint, anchor bigint, context bigint, copies bigint, base int, windows int, bytes binary, piece bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body, wanted in zip(b.column(0), b.column(1), strict=True):
                body = body.as_py()
                rows = []
                for w in wanted.as_py():
                    at, n, off = w["at"], w["windows"], w["off"]
                    if not w["hot"]:
                        rows.append((w["anchor"], w["anchor"], w["context"], w["copies"], 0, n, body[at : at + n + LENGTH - 1]))
                        continue
                    # Window k stands off - k bytes before the anchor; those of one stride share a core.
                    for stride in range((off - n + 1) // STRIDE, off // STRIDE + 1):
                        first = max(0, off - (stride * STRIDE + STRIDE - 1))
                        last = min(n - 1, off - stride * STRIDE)
                        core = at + off - stride * STRIDE
                        seed = (w["anchor"] * 64 + stride) & (1 << 64) - 1
                        shard = xxhash.xxh3_64_intdigest(body[core : core + LENGTH - STRIDE + 1], seed) >> 1
                        rows.append((shard, w["anchor"], w["context"], w["copies"], first, last - first + 1, body[at + first : at + last + LENGTH]))
                rows = [(*r, _signed(xxhash.xxh3_64_intdigest(r[-1]))) for r in rows]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    return texts.select("body", "wanted").mapInArrow(run, schema)


def repeated(contexts: list[bytes], windows: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its windows start anywhere else too (by the suffix array of all)."""
    sizes = np.array([len(c) for c in contexts])
    # a separator (1) after each context, the least symbol (0) at the end, bytes from 2
    t = np.ones(sizes.sum() + len(contexts) + 1, np.uint16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(t) - 1, bool)
    inside[starts + sizes] = False
    t[:-1][inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 2
    t[-1] = 0
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa, starts, 2 * LENGTH + WINDOWS + 8)
    # Suffixes in order fall into groups that share LENGTH bytes.
    group = np.empty(len(t), np.int64)
    group[sa] = np.cumsum(lcp[sa] < LENGTH)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    weight = np.bincount(group[at], np.repeat(copies, windows))
    hit = weight[group[at]] >= 2
    return np.split(hit, np.cumsum(windows)[:-1])


def _compare(pieces: DataFrame) -> DataFrame:
    """shard, piece, from, to: ranges of windows that are repeated, by the suffix arrays of whole shards."""
    schema = "shard bigint, piece bigint, from int, to int"

    def block(rows: list[tuple]) -> pa.RecordBatch:
        hits = repeated([r[4] for r in rows], np.array([r[3] for r in rows]), np.array([r[2] for r in rows], float))
        out: list[tuple] = []
        for r, hit in zip(rows, hits, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out += [(r[0], r[1], a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "piece", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, shard = 0, None
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held >= SHARD_BYTES and r[0] != shard:
                    yield block(rows)
                    rows, held = [], 0
                rows.append(r)
                shard, held = r[0], held + len(r[4])
        if rows:
            yield block(rows)

    dealt = pieces.repartition("shard").sortWithinPartitions("shard")
    return dealt.select("shard", "piece", "weight", "windows", "bytes").mapInArrow(run, schema)


def _by_window(pieces: DataFrame) -> DataFrame:
    """shard, piece, from, to of the windows whose bytes another one has, each dealt by its own bytes."""
    schema = "shard bigint, piece bigint, from int, window binary, weight bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for shard, piece, weight, n, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                view = memoryview(body)
                for k in range(n):
                    for column, value in zip(out, (shard, piece, k, xxhash.xxh3_128_digest(view[k : k + LENGTH]), weight), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    windows = stored(pieces.select("shard", "piece", "weight", "windows", "bytes").mapInArrow(run, schema))
    twice = stored(windows.groupBy("window").agg(F.sum("weight").alias("n")).filter("n > 1").select("window"))
    return windows.join(twice, "window").select("shard", "piece", "from", (F.col("from") + 1).alias("to"))


def _wanted() -> Column:
    return F.struct("anchor", "context", "copies", "at", "windows", "off", "hot")


def removals(addressed: DataFrame) -> DataFrame:
    """doc, from, to: byte ranges to remove (ranges may overlap and repeat)."""
    found = stored(anchors(addressed))
    # Reductions are written before they are joined back: a hot anchor's rows then come from a plain
    # exchange, which adaptive execution can split.
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    shared = stored(found.join(often, "anchor"))
    contexts = shared.groupBy("anchor", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "at", "windows", "off")).alias("one")
    )
    contexts = stored(contexts.select("anchor", "context", "copies", "one.*"))
    several = stored(contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    wanted = contexts.join(several, "anchor").withColumn("hot", F.col("n") > HOT)
    by_doc = wanted.groupBy("doc").agg(F.collect_list(_wanted()).alias("wanted"))
    cut = stored(_cut(addressed.select("doc", "body").join(by_doc, "doc")))
    # Rows that repeat have one address: their contexts are cut from each of them, to the same end.
    placed = stored(cut.select("shard", "piece", "anchor", "context", "copies", "base").distinct())
    weights = placed.groupBy("shard", "piece").agg(F.sum("copies").alias("weight"))
    bodies = cut.groupBy("shard", "piece").agg(F.first("windows").alias("windows"), F.first("bytes").alias("bytes"))
    pieces = stored(bodies.join(weights, ["shard", "piece"]))
    counts = stored(pieces.groupBy("shard").agg(F.count("*").alias("pieces")).filter("pieces > 1"))
    crowd = F.col("pieces") > HOT
    several = pieces.join(counts, "shard")
    found = _compare(several.filter(~crowd))
    if not counts.filter(crowd).isEmpty():
        found = found.unionByName(_by_window(several.filter(crowd)))
    heavy = pieces.filter("weight > 1").select("shard", "piece", F.lit(0).alias("from"), F.col("windows").alias("to"))
    ranges = stored(found.unionByName(heavy)).join(placed.select("shard", "piece", "anchor", "context", "base"), ["shard", "piece"])
    ranges = ranges.select("anchor", "context", (F.col("base") + F.col("from")).alias("from"), (F.col("base") + F.col("to")).alias("to")).distinct()
    whole = contexts.filter("copies > 1").select(
        "anchor", "context", F.lit(0).alias("from"), F.col("windows").cast("int").alias("to")
    )
    covered = stored(ranges.join(whole.select("anchor", "context"), ["anchor", "context"], "left_anti").unionByName(whole))
    return shared.join(covered, ["anchor", "context"]).select(
        "doc", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to") + LENGTH - 1).alias("to")
    )


def _keep(body: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(remaining bytes, number of maximal removed runs)."""
    kept, at, spans, end = [], 0, 0, -1
    for a, b in sorted(ranges):
        if a > end:
            kept.append(body[at:a])
            spans += 1
        end = max(end, b)
        at = end
    kept.append(body[at:])
    return b"".join(kept), spans


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and body (binary): what is left of every row's text."""
    return _each(docs, key, text, "doc_id bigint, body binary", lambda body, kept, spans: (kept,))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _each(
        docs, key, text, RESULT,
        lambda body, kept, spans: (len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest()),
    )


def _each(docs: DataFrame, key: str, text: str, schema: str, row) -> DataFrame:
    addressed = _address(docs, key, text)
    gone = removals(addressed).groupBy("doc").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    both = addressed.join(gone, "doc", "left").select("key", "body", "ranges")
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                out = []
                for k, body, ranges in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    body = body.as_py()
                    out.append((k, *row(body, *_keep(body, [(r["from"], r["to"]) for r in ranges.as_py() or ()]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return both.mapInArrow(run, schema)
