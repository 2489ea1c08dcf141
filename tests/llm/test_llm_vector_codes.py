"""Vector codes against a plain version that compares every part with every entry."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, code string"


def brute(rows):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    parts = [[(v + [0] * (8 * width))[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[parts[k][p] for k in order[:16]] for p in range(8)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        new = []
        for p in range(8):
            chosen = defaultdict(list)
            for x in parts:
                chosen[near(p, x[p])[1]].append(x[p])
            new.append([[sum(c) // len(chosen[e]) for c in zip(*chosen[e], strict=True)] if e in chosen else books[p][e] for e in range(len(books[p]))])
        books = new
    found = [[near(p, x[p]) for p in range(8)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    of = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors, strict=True):
        of[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, of[lab], sha) for (i, _, lab), f, err in zip(kept, found, errors, strict=True)]


def compressed(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(df).collect()
    return sorted((tuple(r)[:5] for r in got), key=str)


def vectors(rng, n, width, spread=1.0):
    return [[rng.gauss(0, spread) * (1 + k % 5) for _ in range(width)] for k in range(n)]


@pytest.mark.parametrize("n,width", [(120, 16), (5, 8), (60, 24), (16, 8)])
def test_codes_equal_the_plain_version(spark, n, width):
    rng = random.Random(n)
    values = np.array(vectors(rng, n, width), np.float32).astype(float).tolist()
    rows = [(i * 3 % n, v, rng.choice([None, 1, 2])) for i, v in enumerate(values)]
    assert compressed(spark, rows) == sorted(brute(rows), key=str)


def test_dropped_rows_ties_and_repeats(spark):
    rng = random.Random(4)
    line = [[rng.choice([-0.5, 0.25, 0.5]) for _ in range(8)] for _ in range(12)]
    rows = [(i % 20, line[i % 12], i % 2 or None) for i in range(50)]
    rows += [(None, line[0], None), (None, line[3], 7), (900, None, 1), (901, [0.5, None] * 4, 1), (902, [float("nan")] * 8, 2), (903, [float("-inf")] * 8, 2)]
    assert compressed(spark, rows) == sorted(brute(rows), key=str)


def test_short_and_empty_vectors(spark):
    rows = [(1, [0.5, -0.25, 1.0], 1), (2, [], 1), (3, [0.125] * 11, None), (4, [-1.0] * 9, 2)]
    assert compressed(spark, rows) == sorted(brute(rows), key=str)
    assert compressed(spark, [(1, [], None)]) == sorted(brute([(1, [], None)]), key=str)


def test_empty_table_and_too_large_components(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compressed(spark, [(1, None, 3)]) == []
    with pytest.raises(ValueError, match="pass a long"):
        compressed(spark, [(1, [-3e38] * 8, 1)])


def test_annulus_finds_what_a_full_search_finds():
    """Entries of unlike norms: the same entries as by all distances, from a part of them."""
    rng = np.random.default_rng(3)
    scale = np.exp(rng.normal(0, 2, (16, 1)))
    entries = (rng.normal(0, 400, (16, 8)) * scale).astype(np.int64)
    entries[5] = entries[9]
    points = entries[rng.integers(0, 16, 3000)] + rng.integers(-30, 30, (3000, 8))
    best, least, done = vector_codes.nearest(points, entries)
    every = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    assert done < 3000 * 16 / 2


def test_many_labels_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MAX_BROADCAST_LABELS", 1)
    rng = random.Random(11)
    values = np.array(vectors(rng, 90, 8), np.float32).astype(float).tolist()
    rows = [(i, v, rng.choice([None, 1, 1, 1, 2])) for i, v in enumerate(values)]
    assert compressed(spark, rows) == sorted(brute(rows), key=str)


def test_decoded_vectors_lie_at_the_stated_error(spark):
    rng = random.Random(12)
    rows = [(i, v, 1, "x", "y") for i, v in enumerate(np.array(vectors(rng, 70, 16), np.float32).astype(float).tolist())]
    whole = vector_codes.integers(spark.createDataFrame(rows, SCHEMA))
    books = vector_codes.fit(whole)
    back = vector_codes.decode(vector_codes.encode(whole, books), books).join(whole.select("vec_id", "q"), "vec_id").collect()
    assert len(back) == 70 and all(sum((a - b) ** 2 for a, b in zip(r.restored, r.q, strict=True)) == r.error for r in back)
