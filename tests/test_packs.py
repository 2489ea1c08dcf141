"""Packs filled in order against a plain loop."""

import random

import pytest

from millrace.operators import packs


def plain(rows, capacity):
    out, state = {}, {}
    for source, at, size in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        pack, held = state.get(source, (-1, None))
        if held is None or held + (size or 0) > capacity:
            pack, held = pack + 1, 0
        state[source] = pack, held + (size or 0)
        out[source, at] = pack
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 10_000])
def test_packs_equal_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(packs, "BLOCK", block)
    rng = random.Random(block)
    rows = [(s, i * 2, rng.choice([0, 0, 1, 3, 5, 9, 10, 11, 25, None])) for s in ("a", "b", None) for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "s string, o int, z int, _block string, pack int").repartition(3)
    assert {(r.s, r.o): r.pack for r in packs.filled(df, "s", "o", "z", 10).collect()} == plain(rows, 10)


def test_empty_tables_and_one_unit(spark):
    schema = "s string, o int, z int"
    assert packs.filled(spark.createDataFrame([], schema), "s", "o", "z", 10).count() == 0
    assert packs.filled(spark.createDataFrame([("a", 1, 99)], schema), "s", "o", "z", 10).collect()[0].pack == 0
