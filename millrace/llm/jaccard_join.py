"""Size-aware heavy-light Jaccard join on word shingles, with components.

Two texts link when 100 * |intersection| >= p * |union| of their sets of
distinct shingles of k words (64-bit hashes); a ``Rule`` holds k and p, by default
the three words and 90 of ``op3``.  Texts of equal sets form one class; links
are sought between classes, represented by their least row.

Light sets.  While a union has fewer than 200 / (100 - p) shingles (20 at 90, 10
at 80), a link means that the sets differ by one shingle at most.  A set of n
therefore emits the digests of its n subsets of size n - 1 and its own; an equal
digest is a link, with no verification.

Heavy sets.  Shingles are ordered from rare to common, and linked sets share one
of their first n - ceil(p n / 100) + 1.  Inverted lists over these prefixes are
scanned: in each list the set that holds the shingle earliest is the hub.
Length and positional bounds discard pairs that cannot link, the others are
verified on the whole sets.  A first round compares each list's members with its
hub alone.  A second compares, in lists whose members are still in several
components, every member outside the hub's component with every member of other
components, under the same bounds and two more.  A bitmap of each set's
shingles bounds the difference of two sets from below: bits that differ stand
for at least so many shingles that one set lacks.  And a pair is passed on only
where it begins to share lists: if the last lists of both before this one have
one in common, the pair was met there.  No link between components is lost, and
a large group of near copies makes one pair for each member and the pairs close
to the limit, not all pairs, whether or not its members link.

The boundary between light and heavy is the one of least total cost: sizes are
counted, a light set costs its n + 1 digests, and a heavy one the scan of the
lists of its prefix, whose lengths are quantiles of the counters below.

Rarity comes from a table of ``BUCKETS`` counters over all shingles of all rows
(4 MB whatever the input; counters can only overestimate).  It only orders
shingles: any order gives the same links.

Null and empty texts and texts without words have no set and link with nothing.
Texts are read whole, whatever their length.  Rows of one id and text are
copies of each other; an id is one node, so a caller whose ids repeat with other
texts keys the rows (as the pipeline's stage does).  Rows without id are left out
of links and are their own component (null).  An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shared import stored

BUCKETS, BLOCK = 1 << 20, 1 << 14
#: Relative costs: emitting and shuffling one digest, and comparing one list member.
DIGEST_COST, SCAN_COST = 1.0, 4.0
#: Words a worker remembers; executors run several workers beside the JVM's heap.
MEMO = 1 << 17
#: Words of 64 bits in a set's bitmap, and earlier lists that an entry remembers.
WORDS, EARLIER = 8, 2
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Rule:
    """Words of a shingle and the least similarity in hundredths (below 100), with the bounds that follow."""

    shingle: int = 3
    percent: int = 90

    def prefix_size(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    @property
    def least_light(self) -> int:
        """The least size at which sets that differ by one shingle link."""
        return -(-100 // (100 - self.percent)) - 1

    @property
    def max_light(self) -> int:
        """The largest size whose links differ by one shingle at most, whatever the other set."""
        n = 0
        while 100 * (n + 1) // self.percent * (100 - self.percent) < 200:
            n += 1
        return n

    def near(self, apart: Column, a: Column, b: Column) -> Column:
        """Whether sets of sizes a and b that differ by ``apart`` shingles link."""
        return (100 + self.percent) * apart <= (100 - self.percent) * (a + b)

    def linked(self, overlap: Column, a: Column, b: Column) -> Column:
        return 100 * overlap >= self.percent * (a + b - overlap)


#: The rule of ``op3``.
CONTRACT = Rule()


class Words(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, memo: Words, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words; fewer words are one shingle."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(own) < size:
        return _mix(np.array([sum(int(h) * (2 * i + 3) for i, h in enumerate(own)) + len(own) & (1 << 64) - 1], np.uint64))
    n = len(own) - size + 1
    h = own[:n]
    for k in range(1, size):
        h = _mix(h * _M1 + own[k : k + n])
    return np.unique(h)


def _signature(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; those of a subset follow by subtraction."""
    other = _mix(found * _M1 + _M2)
    return int(found.sum(dtype=np.uint64)), int(other.sum(dtype=np.uint64))


def bitmap(found: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles at each of 64 * ``WORDS`` bits: maps of two sets differ in no more bits than the sets do."""
    at = (_mix(found * _M2) & np.uint64(64 * WORDS - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _binaries(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


@dataclass
class Order:
    """The counters, and the largest size that counts as light."""

    counters: np.ndarray
    light: int


def profile(docs: DataFrame, key: str, text: str, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """(key, n, s1, s2 of every row; the counters): one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counters = Words(), np.zeros(BUCKETS, np.int64)
        names = ["key", "n", "s1", "s2", "counts"]
        for b in batches:
            n, sums = [], []
            for t in b.column(1):
                found = shingle_set(t.as_py() or "", memo, rule.shingle)
                np.add.at(counters, (found & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                n.append(len(found))
                sums.append(_signature(found))
            s = _signed(np.array(sums, np.uint64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.nulls(len(n), pa.binary())],
                names,
            )
        if counters.any():
            at = list(range(0, BUCKETS, BLOCK))
            rows = [counters[i : i + BLOCK].astype("<u4") for i in at]
            empty = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([-1] * len(at), pa.int64()), empty, empty, _binaries(rows)], names)

    both = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key bigint, n bigint, s1 bigint, s2 bigint, counts binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), _binaries([x.clip(max=2**32 - 1).astype("<u4") for x in total.values()])], ["at", "counts"]
            )

    parts = both.filter("n = -1").select("key", "counts").repartition(BUCKETS // BLOCK // 8, "key")
    counters = np.zeros(BUCKETS, np.int64)
    for r in parts.mapInArrow(add, "at bigint, counts binary").collect():  # BUCKETS counters in all
        counters[r["at"] : r["at"] + BLOCK] = np.frombuffer(r["counts"], "<u4")
    return both.filter("n >= 0").select("key", "n", "s1", "s2"), counters


def light_limit(counters: np.ndarray, sizes: dict[int, int], rule: Rule = CONTRACT) -> int:
    """The largest light size: of all boundaries the rule allows, the one of least total cost.

    ``sizes`` counts the sets of each size up to a little beyond ``rule.max_light``.
    """
    # List lengths as a set's shingles meet them, less what a counter holds by chance.
    lengths = np.sort(counters[counters > 0])
    share = np.cumsum(lengths) / max(1, lengths.sum())
    chance = lengths.sum() / len(counters)

    def scan(n: int) -> float:
        """The cost of scanning the lists of the rarest of n shingles."""
        at = np.searchsorted(share, np.arange(1, rule.prefix_size(n) + 1) / (n + 1)).clip(max=len(lengths) - 1)
        return SCAN_COST * float(np.maximum(1.0, lengths[at] - chance).sum())

    def total(limit: int) -> float:
        top = -(-100 * limit // rule.percent)  # heavier sets meet light ones by their digests
        light = sum(k * DIGEST_COST * (n + 1) for n, k in sizes.items() if rule.least_light <= n <= top)
        return light + sum(k * scan(n) for n, k in sizes.items() if limit < n)

    if not len(lengths):
        return rule.max_light
    return min(range(rule.least_light - 1, rule.max_light + 1), key=total)


def _entries(docs: DataFrame, classes: DataFrame, key: str, text: str, order: Order, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prefix entries of the heavy classes, digests of the light ones, bitmaps of the heavy ones)."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, own = Words(), sent.value
        top = -(-100 * own.light // rule.percent)
        for b in batches:
            n, heads, digests, maps = [], [], [], []
            for t in b.column(1):
                found = shingle_set(t.as_py() or "", memo, rule.shingle)
                size = len(found)
                n.append(size)
                if size > own.light:
                    rarity = own.counters[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    heads.append(found[np.lexsort((found, rarity))[: rule.prefix_size(size)]])
                    maps.append(bitmap(found))
                else:
                    heads.append(found[:0])
                    maps.append(found[:0])
                if rule.least_light <= size <= top:
                    other = _mix(found * _M1 + _M2)
                    # row 0 is the set itself, the others lack one shingle each
                    one = np.concatenate([[found.sum(dtype=np.uint64)], found.sum(dtype=np.uint64) - found])
                    two = np.concatenate([[other.sum(dtype=np.uint64)], other.sum(dtype=np.uint64) - other])
                    digests.append(np.stack([one, two], 1).ravel())
                else:
                    digests.append(found[:0])
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, x)]), pa.int32()),
                    pa.array(_signed(np.concatenate([found[:0], *x]) if x else np.zeros(0, np.uint64))),
                )
                for x in (heads, digests, maps)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["key", "n", "head", "digests", "bits"])

    raw = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, "key bigint, n bigint, head array<bigint>, digests array<bigint>, bits array<bigint>"
    )
    # Only class representatives go on; the join moves heads, not texts.
    chosen = stored(
        raw.filter((F.size("head") > 0) | (F.size("digests") > 0)).join(classes.select("key", "n"), ["key", "n"])
    )
    heavy = chosen.select("key", "n", F.posexplode("head").alias("at", "token"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("digests") - 2, F.lit(2)),
        lambda i: F.struct(F.get("digests", i).alias("s1"), F.get("digests", i + 1).alias("s2")),
    )
    light = chosen.filter(F.size("digests") > 0).select("key", "n", F.posexplode(pairs).alias("at", "d"))
    bits = chosen.filter(F.size("bits") > 0).select("key", *[F.get("bits", i).alias(f"bits{i}") for i in range(WORDS)])
    return heavy, light.select("key", "n", "at", "d.s1", "d.s2"), bits


def _bounds(x: str, y: str, rule: Rule) -> Column:
    """Whether sizes and the places of a shared shingle leave room for a link.

    Of the shingles before it only those in lists of several members can match.
    """
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    rest = F.least(nx - F.col(f"{x}at"), ny - F.col(f"{y}at"))
    most = rest + F.least(F.col(f"{x}before"), F.col(f"{y}before"))
    return (100 * nx >= rule.percent * ny) & (100 * ny >= rule.percent * nx) & rule.linked(most, nx, ny)


def _unmet(x: str, y: str) -> Column:
    """Whether the last open lists of both members before this one have none in common."""
    same = [F.col(f"{x}last{i}") == F.col(f"{y}last{j}") for i in range(1, EARLIER + 1) for j in range(1, EARLIER + 1)]
    return ~reduce(or_, [F.coalesce(s, F.lit(False)) for s in same])


def _apart(x: str, y: str) -> Column:
    """At least so many shingles are in one of the two sets alone."""
    return reduce(add, [F.bit_count(F.col(f"{x}bits{i}").bitwiseXOR(F.col(f"{y}bits{i}"))) for i in range(WORDS)])


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    pairs = stored(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingle_set(t.as_py() or "", memo, rule.shingle) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), _binaries(found)], ["key", "found"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = stored(rows.join(wanted.hint("shuffle_hash"), "key").mapInArrow(sets, "key bigint, found binary"))
    both = pairs.join(found.select(F.col("key").alias("a"), F.col("found").alias("fa")), "a").join(
        found.select(F.col("key").alias("b"), F.col("found").alias("fb")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.select("a", "b", "fa", "fb").mapInArrow(check, "a bigint, b bigint"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """(key, n, class of every row with an id; edges a, b between classes that join all components)."""
    rows, counters = profile(docs.filter(F.col(key).isNotNull()), key, text, rule)
    # Written, so that the join back to a class of many copies reads plain exchanges, which can be split.
    classes = stored(rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("class")))
    # Beyond the rule's largest light size, digests of one deletion would miss links.
    small = rows.filter(F.col("n").between(1, 2 * rule.max_light)).groupBy("n").agg(F.count("*").alias("k"))
    order = Order(counters, light_limit(counters, {r.n: r.k for r in small.collect()}, rule))
    heavy, light, bits = _entries(docs, classes.select(F.col("class").alias("key"), "n"), key, text, order, rule)

    own = light.filter("at = 0").select("s1", "s2", F.col("key").alias("a"), F.col("n").alias("an"))
    less = light.filter("at > 0").select("s1", "s2", F.col("key").alias("b"), F.col("n").alias("bn"))
    subset = own.join(less, ["s1", "s2"]).filter(F.col("an") + 1 == F.col("bn")).select("a", "b")

    shared = heavy.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1").select("token")
    before = F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1
    entries = stored(heavy.join(shared, "token").withColumn("before", before))
    hubs = entries.groupBy("token").agg(
        F.min_by(F.struct("key", "n", "at", "before"), F.struct("before", "at", "key")).alias("hub")
    )
    hubs = hubs.select("token", "hub.*").toDF("token", "hkey", "hn", "hat", "hbefore")
    entries = stored(entries.join(hubs, "token"))
    stars = entries.filter((F.col("key") != F.col("hkey")) & _bounds("", "h", rule)).select(
        F.least("key", "hkey").alias("a"), F.greatest("key", "hkey").alias("b")
    )
    first = stored(_verified(stars, docs, key, text, rule).unionByName(subset))
    roots = stored(components(first))

    def root(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(of), F.col("root").alias(name)), of, "left").withColumn(
            name, F.coalesce(name, of)
        )

    placed = root(root(entries, "key", "root"), "hkey", "hroot")
    split = stored(placed.filter("root <> hroot").select("token").distinct())
    open_ = placed.join(split.hint("shuffle_hash"), "token").select("token", "key", "n", "at", "before", "root", "hroot", "hkey")
    # Members of different components share open lists alone, so these lists tell where a pair was met before.
    last = Window.partitionBy("key").orderBy("at")
    open_ = stored(open_.withColumns({f"last{i}": F.lag("token", i).over(last) for i in range(1, EARLIER + 1)}).join(bits, "key"))
    carried = [c for c in open_.columns if c not in ("token", "hkey", "hroot")]
    x = open_.filter("root <> hroot").select("token", *[F.col(c).alias(f"x{c}") for c in carried])
    y = open_.select("token", "hkey", "hroot", *[F.col(c).alias(f"y{c}") for c in carried])
    # Pairs outside the hub's component are met from the lesser key alone; the hub was compared before.
    once = (F.col("yroot") == F.col("hroot")) | (F.col("xkey") < F.col("ykey"))
    crossed = x.join(y, "token").filter(
        (F.col("xroot") != F.col("yroot")) & once & (F.col("ykey") != F.col("hkey")) & _bounds("x", "y", rule)
        & _unmet("x", "y") & rule.near(_apart("x", "y"), F.col("xn"), F.col("yn"))
    )
    second = _verified(
        crossed.select(F.least("xkey", "ykey").alias("a"), F.greatest("xkey", "ykey").alias("b")), docs, key, text, rule
    )
    edges = first.unionByName(second)
    members = rows.filter("n > 0").join(classes, ["n", "s1", "s2"]).select("key", "n", "class")
    return members.unionByName(rows.filter("n = 0").select("key", "n", F.col("key").alias("class"))), edges


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row."""
    members, edges = links(docs, key, text, rule)
    roots = components(edges)
    out = members.join(roots, F.col("class") == F.col("node"), "left").select(
        F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("root", "class").alias("component_id"), F.col("class").alias("class_id"),
    )
    # Rows without an id link with nothing.
    lone = profile_sizes(docs.filter(F.col(key).isNull()), text, rule)
    return out.unionByName(lone)


def profile_sizes(docs: DataFrame, text: str, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in batches:
            n = [len(shingle_set(t.as_py() or "", memo, rule.shingle)) for t in b.column(0)]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none, none], ["doc_id", "n_shingles", "component_id", "class_id"])

    return docs.select(text).mapInArrow(run, "doc_id bigint, n_shingles bigint, component_id bigint, class_id bigint")
