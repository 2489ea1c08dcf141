"""Neighbouring units of a source filled into packs of a capacity, in order, without gathering a source.

A pack takes units until the next one does not fit.  Where a pack begins depends
on all before it, so units are cut into blocks of ``BLOCK`` places.  What a block
needs from those before is one number, the sum before the open pack's first
unit; it decides which unit of the block begins the next pack, and only units
within one capacity of the block's start can.  A block tells for each of these
which pack is open at its end; the blocks of a source are chained over these few
rows; then each block, knowing its first pack, fills its units in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import review
from millrace.operators.storage import stored

#: Units of a block; what a task holds at once.
BLOCK = 10_000


def _jumps(before: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """For each unit, the first one after it for which a pack begun there has no room (their number if all fit)."""
    return np.maximum(np.searchsorted(before + size, before + capacity, "right"), np.arange(len(size)) + 1)


def _columns(block: pa.Table, *names: str) -> list[np.ndarray]:
    block = block.sort_by("_at")
    return [block[n].to_numpy() for n in names]


def filled(units: DataFrame, by: str, order: str, size: str, capacity: int) -> DataFrame:
    """by, order, pack (from 0 in each source): packs hold ``capacity`` at most, but a larger unit has a pack of
    its own.  Null sizes count as 0; a null source is one of its own; equal orders come in any order."""
    kind = units.schema[by].dataType.simpleString()
    clean = units.select(by, order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    placed = review.running(clean, by, [order], F.lit(1), "_at")
    placed = review.running(placed, by, [order, "_at"], F.col("_size"), "_before")
    placed = stored(placed.withColumn("_block", F.floor(F.col("_at") / BLOCK)))

    def told(block: pa.Table) -> pa.Table:
        before, sizes = _columns(block, "_before", "_size")
        after = _jumps(before, sizes, capacity)
        n = len(before)
        begun, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            begun[i] = 1 + begun[after[i]]
            last[i] = i if after[i] == n else last[after[i]]
        can = np.flatnonzero(before <= before[0] + capacity)
        numbers = [np.full(len(can), block["_block"][0].as_py()), can, before[can] + sizes[can], before[last[can]], begun[can]]
        source = pa.array([block[by][0].as_py()] * len(can), block[by].type)
        return pa.table([source, *(pa.array(x, pa.int64()) for x in numbers)], names=[by, "_block", "_entry", "_until", "_open", "_begun"])

    def chained(rows: pa.Table) -> pa.Table:
        out, held, packs = [], None, 0
        blocks: dict[int, list[tuple]] = {}
        for b, *entry in zip(*(rows[c].to_pylist() for c in ("_block", "_entry", "_until", "_open", "_begun")), strict=True):
            blocks.setdefault(b, []).append(tuple(entry))
        for b in sorted(blocks):
            found = next((e for e in sorted(blocks[b]) if held is None or e[1] > held + capacity), None)
            out.append((b, -1 if found is None else found[0], packs))
            if found is not None:
                held, packs = found[2], packs + found[3]
        source = pa.array([rows[by][0].as_py()] * len(out), rows[by].type)
        return pa.table([source, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=[by, "_block", "_first", "_packs"])

    def assigned(block: pa.Table, chain: pa.Table) -> pa.Table:
        before, sizes = _columns(block, "_before", "_size")
        after = _jumps(before, sizes, capacity)
        starts, at = np.zeros(len(before), np.int64), chain["_first"][0].as_py()
        while 0 <= at < len(before):
            starts[at] = 1
            at = after[at]
        pack = chain["_packs"][0].as_py() - 1 + np.cumsum(starts)
        block = block.sort_by("_at")
        return pa.table([block[by], block[order], pa.array(pack, pa.int64())], names=[by, order, "pack"])

    keys = [by, "_block"]
    steps = placed.groupBy(*keys).applyInArrow(told, f"`{by}` {kind}, _block bigint, _entry bigint, _until bigint, _open bigint, _begun bigint")
    chain = steps.groupBy(by).applyInArrow(chained, f"`{by}` {kind}, _block bigint, _first bigint, _packs bigint")
    schema = f"`{by}` {kind}, `{order}` {units.schema[order].dataType.simpleString()}, pack bigint"
    return placed.groupBy(*keys).cogroup(stored(chain).groupBy(*keys)).applyInArrow(assigned, schema)
