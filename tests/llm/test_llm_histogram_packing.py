"""Best-fit packing from counts against best-fit over single documents."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import histogram_packing

MODEL = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, length string, rank string, task string"


def best_fit(lengths, capacity):
    """The number of sequences of best-fit decreasing, one document at a time."""
    rooms, opened = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        opened += room == capacity
        bisect.insort(rooms, room - x)
        if not rooms[0]:
            rooms.pop(0)
    return opened


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_best_fit_over_documents(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 256])
    mean = capacity * rng.choice([0.05, 0.2, 0.5])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / mean))) for _ in range(rng.randrange(900))]
    slots, n = histogram_packing.plan(dict(Counter(lengths)), capacity)
    assert n == best_fit(lengths, capacity) and len(slots) < 40 * capacity
    ranks, filled = defaultdict(list), defaultdict(list)
    for s in slots:
        ranks[s.length] += range(s.rank, s.rank + s.count)
        for k in range(s.count):
            filled[s.sequence + k // s.each].append((s.offset + k % s.each * s.length, s.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in Counter(lengths).items()}
    assert sorted(filled) == list(range(n))
    for places in filled.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize("histogram", [{i: 10**9 + i * 7919 for i in range(1, 4097)}, {i: 1 for i in range(1, 4097)}, {1: 10**12}])
def test_plan_is_small_whatever_the_counts(histogram):
    slots, n = histogram_packing.plan(histogram)
    tokens = sum(k * v for k, v in histogram.items())
    assert len(slots) < 40 * 4096 and n <= 1.01 * -(-tokens // 4096)


def texts(rng):
    out = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 3, 20, 60, 300]))) for _ in range(120)]
    return out + ["the same text"] * 80 + ["", None, " \n", "Ünïcode 日本語 😀", "x " * 9000, "alpha " * 4095, "alpha " * 4096]


def test_pieces_are_whole_and_sequences_gapless(spark):
    given = texts(random.Random(1))
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(given)] + [(None, "no id", "", "", ""), (3, given[3], "", "", "")]
    got = histogram_packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(6), MODEL).collect()
    encode = Tokenizer.from_file(MODEL).encode
    expected, lengths = [], []
    for i, t, *_ in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            lengths.append(len(cut))
            expected.append((i, piece, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 4096
    assert len(places) == best_fit(lengths, 4096)


def test_an_empty_table(spark):
    assert histogram_packing.pack(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
