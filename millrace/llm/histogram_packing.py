"""Best-fit packing planned over a histogram of lengths.

A document longer than ``capacity`` is cut into pieces of ``capacity`` tokens
and a shorter rest; any other is one piece.  How many pieces have each length is
all that a plan needs: longest first, pieces of a length go to the sequences of
least sufficient room, as many to one as fit, else to new ones.  Sequences of
equal room are planned together as a run of numbers, so that the work depends on
the capacity alone.

1. One pass tokenizes and writes the pieces (numbers only), each with its task
   and its rank among the task's pieces of its length.
2. Counts by task and length are summed: over tasks to the histogram (``capacity``
   rows at most), and along the tasks of a length to the first rank of each task.
3. The driver plans the histogram.  A plan has less than ``40 * capacity`` rows
   whatever the corpus (a length splits two runs at most, and each use of a run
   leaves less than half of its room), which bounds its broadcast.
4. A piece's rank within its length is its task's first rank plus its own; it
   takes the planned slot that holds this rank.

No length is ever gathered or sorted: a third of all pieces may have one length.
The pieces are written before they are read twice, so a task that is lost and
run again, or a plan that follows another order, cannot disagree with the counts.

Null texts count as empty and consist of the end id alone.  Null or repeated
ids are carried along; a text of any length is read whole; equal lengths follow
the order of tasks and rows, which decides nothing but which of them go
together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.shared import stored
from millrace.llm.tokens import word_ids

CAPACITY, END_ID = 4096, 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class Slots(NamedTuple):
    """Slots of the pieces of one length with ranks from ``rank``, ``count`` in number: ``each`` of them
    in a sequence, from ``sequence`` on, the first of each at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slots], int]:
    """(slots, number of sequences): best-fit decreasing, over counts."""
    slots: list[Slots] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    rooms: list[int] = []  # those with runs, ascending
    opened = 0

    def leave(room: int, sequence: int, number: int) -> None:
        if room and number:
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append((sequence, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = int(np.searchsorted(rooms, length))
            if at < len(rooms):
                room = rooms[at]
                sequence, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                # New sequences, in one run: as many as what is left needs.
                room, sequence = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            each = room // length
            filled = min(number, left // each)
            if filled:
                slots.append(Slots(length, rank, filled * each, sequence, each, capacity - room))
                leave(room - each * length, sequence, filled)
                rank, left = rank + filled * each, left - filled * each
                sequence, number = sequence + filled, number - filled
            if number and left:
                slots.append(Slots(length, rank, left, sequence, left, capacity - room))
                leave(room - left * length, sequence, 1)
                rank, left, sequence, number = rank + left, 0, sequence + 1, number - 1
            leave(room, sequence, number)
    return slots, opened


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text), with its task and its rank there within its length."""
    model = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, "rb").read())  # a file of fixed size
    end = np.array([END_ID], "<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(model.value)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode.all(text.as_py() or "") + end)
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    row = (key, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length])
                    seen[length] += 1
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def take_slots(pieces: DataFrame, slots: list[Slots]) -> DataFrame:
    """``pieces`` (with ``first``, the first rank of their task) at the slots of their ranks."""
    table = np.array(sorted(slots), np.int64).reshape(-1, len(Slots._fields))
    sent = pieces.sparkSession.sparkContext.broadcast(table)  # under 40 * capacity rows
    names = [x.split()[0] for x in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, each, offset = sent.value.T
        # Slots of one length follow each other by rank: (length, rank) in one number finds the last not after it.
        begins = np.searchsorted(length, np.arange(int(length.max()) + 2))
        for batch in batches:
            own = batch.column(3).to_numpy()
            place = batch.column(5).to_numpy() + batch.column(6).to_numpy()
            at = np.empty(len(own), np.int64)
            order = np.lexsort((place, own))
            edges = np.flatnonzero(np.diff(own[order], prepend=-1))
            for rows in np.split(order, edges[1:]):
                low, high = begins[own[rows[0]]], begins[own[rows[0]] + 1]
                at[rows] = low + np.searchsorted(rank[low:high], place[rows], "right") - 1
            within = place - rank[at]
            out = [sequence[at] + within // each[at], offset[at] + within % each[at] * own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, pa.int64()) for c in out)], names)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "first"]
    return pieces.select(*columns).mapInArrow(run, PACKED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text): its sequence and place there."""
    pieces = stored(tokenized(docs, tokenizer_path, capacity))
    counts = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    if not slots:
        return docs.sparkSession.createDataFrame([], PACKED)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # As many first ranks as tasks times lengths: a table that grows, so it is never broadcast.
    return take_slots(pieces.join(stored(firsts).hint("merge"), ["task", "length"]), slots)
