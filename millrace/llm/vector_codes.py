"""Vector code compression: product codes by annular norm pruning.

A vector becomes integers (``floor(SCALE * x)``), is cut into ``PARTS`` equal
parts, and each part is coded by the nearest entry of its position's codebook.
The nearest entry is searched by norms: entries are sorted by norm, the entry
next in norm gives a first distance d, and a binary search the entries whose
norm lies within d of the part's, both ends included.  Only that annulus is
evaluated, exactly, from the part's norm outwards; a nearer entry narrows it.
By the triangle inequality no entry outside it is as near.

Training takes a fixed number of rounds over all rows.  A round is one pass: a
task sums the parts that chose each entry, and the sums of all tasks meet in a
few groups.  The driver holds codebooks alone (``ENTRIES`` vectors, whatever the
table's size).  The integers are written once as Parquet, so that a lost
executor repeats tasks of one pass.

Dropped rows: a null vector, or null or non-finite components.  Others are all
coded, in these ways: a null id comes after all others when the first entries
are chosen, equal ids by their components; repeated rows count each time; equal
distances go to the lower entry; fewer rows than entries give fewer entries; a
vector shorter than the longest counts as ended by zeros, and so does one whose
length ``PARTS`` does not divide; an empty table gives no rows.  A table whose
distances could pass a long is refused.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels of so many rows at most are broadcast to join their sums back; more are joined by a shuffle of salted rows.
MAX_BROADCAST_LABELS, SALTS = 100_000, 64

#: part -> its entries, an integer matrix
Codebooks = list[np.ndarray]


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label and the integer components ``q`` of the rows that are kept."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return rows.filter(F.col("embedding").isNotNull() & whole).select("vec_id", "label", scaled.alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of ``width`` integers, the missing ones zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry of each point, squared distance, how many distances were evaluated)."""
    squares = (entries * entries).sum(1)
    order = np.argsort(squares, kind="stable")
    norms = np.sqrt(squares[order].astype(float))
    own = np.sqrt((points * points).sum(1).astype(float))
    first = np.searchsorted(norms, own)
    below = np.maximum(first - 1, 0)
    first = np.minimum(first, len(norms) - 1)
    first = np.where(np.abs(norms[below] - own) <= np.abs(norms[first] - own), below, first)

    def distance(rows: np.ndarray | slice, j: np.ndarray | int) -> np.ndarray:
        gap = points[rows] - entries[j]
        return (gap * gap).sum(1)

    best = order[first]
    least = distance(slice(None), best)
    done = len(points)
    step = 1
    active = np.arange(len(points))
    while len(active):
        # Roots are rounded, so the annulus is made wider by far more than their error.
        reach = np.sqrt(least[active].astype(float)) * (1 + 1e-9) + 1e-9 * own[active] + 1e-6
        low = np.searchsorted(norms, own[active] - reach, "left")
        high = np.searchsorted(norms, own[active] + reach, "right")
        goes_on = (first[active] - step >= low) | (first[active] + step < high)
        for at, inside in ((first[active] - step, low), (first[active] + step, None)):
            use = at >= inside if inside is not None else at < high
            rows, j = active[use], order[at[use]]
            found = distance(rows, j)
            nearer = (found < least[rows]) | ((found == least[rows]) & (j < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = j[nearer], found[nearer]
            done += len(rows)
        active = active[goes_on]
        step += 1
    return best, least, done


def _parts(points: np.ndarray) -> list[np.ndarray]:
    return np.split(points, PARTS, axis=1)


def _sums(vectors: DataFrame, books: Codebooks, width: int) -> list[tuple[int, int, int, int, int]]:
    """(part, entry, place, sum, count) over all rows; ENTRIES * width rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, ENTRIES, width // PARTS), object)
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            for p, points in enumerate(_parts(matrix(batch.column(0), width))):
                best, _, _ = nearest(points, books[p])
                for e in np.unique(best):
                    sums[p, e] += points[best == e].sum(0)
                    counts[p, e] += (best == e).sum()
        p, e, i = (x.ravel() for x in np.indices(sums.shape))
        used = counts[p, e] > 0
        p, e, i = p[used], e[used], i[used]
        columns = [p, e, i, sums[p, e, i].astype(np.int64), counts[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "e", "i", "s", "n"])

    parted = vectors.select("q").mapInArrow(run, "p bigint, e bigint, i bigint, s bigint, n bigint")
    total = parted.groupBy("p", "e", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")), F.sum("n"))
    return [(r[0], r[1], r[2], int(r[3]), r[4]) for r in total.collect()]


def fit(vectors: DataFrame) -> Codebooks:
    """The codebooks after ``ROUNDS`` rounds over the rows of ``integers``; empty without rows."""
    longest, largest = vectors.agg(
        F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double")))))
    ).first()
    if longest is None:
        return []
    width = -(-longest // PARTS) * PARTS
    if width * 4 * int(largest or 0) ** 2 >= 1 << 62:
        raise ValueError("components are so large that squared distances could pass a long")
    firsts = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    seeds = matrix(pa.array([r.q for r in firsts], pa.list_(pa.int64())), width)
    books = _parts(seeds)
    for _ in range(ROUNDS):
        books = [b.copy() for b in books]
        for p, e, i, total, n in _sums(vectors, books, width):
            books[p][e, i] = total // n
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error, and how many distances were evaluated for the row's batch on average."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(points, books[p]) for p, points in enumerate(_parts(matrix(batch.column(2), width)))]
            codes = np.stack([b for b, _, _ in found], 1).astype(np.uint8)
            errors = sum(d for _, d, _ in found)
            mean = sum(n for _, _, n in found) / max(1, len(codes) * PARTS)
            text = [c.tobytes().hex() for c in codes]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors, pa.int64()), pa.array([mean] * len(text), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "evaluated"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint, evaluated double"
    return vectors.select("vec_id", "label", "q").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with the integer vector ``restored`` that each code stands for."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in e)) for e in b)) for b in books))
    at = F.transform(
        F.sequence(F.lit(0), F.lit(PARTS - 1)),
        lambda p: F.get(F.get(tables, p), F.conv(F.substring("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int")),
    )
    return codes.withColumn("restored", F.flatten(at))


def digest_of(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of an equal label, nulls together."""
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= MAX_BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("_label")
    # A label may hold a third of all rows: its rows are dealt over SALTS keys, its sum is sent to each.
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    each = sums.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(each, same & (F.col("_salt") == F.col("_to"))).drop("_label", "_salt", "_to")


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and evaluated for each kept row of
    ``rows`` (vec_id, embedding, label)."""
    vectors = stored(integers(rows))
    books = fit(vectors)
    if not books:
        coded = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0.0).alias("evaluated"))
    else:
        coded = stored(encode(vectors, books))
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"), "evaluated"
    )
