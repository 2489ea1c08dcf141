"""Cost-balanced packing of tokenized documents into fixed-length sequences.

Each task reads its documents once, tokenizes them and packs them in blocks of
about ``BLOCK_TOKENS`` tokens; nothing is shuffled and a block bounds memory.
Within a block every run of ``capacity`` tokens of a long document is a
sequence of its own.  The remainders, longest first, go to the sequence of
lowest attention cost (linear plus quadratic in the piece lengths) that has
room.  If no sequence has room for all of it, the remainder is cut and the
cheapest sequence filled.  There are just as many full sequences as
the tokens fill; what is left goes to sequences whose lengths are powers of
two, so nothing is padded.

Null texts count as empty and consist of the end id alone.  Null or repeated
ids are carried along; a text of any length is read whole; an empty table gives
no rows; extra columns are ignored.  A task that runs again on the same split gives the same
pieces: order within a block is by length, then by id, then by position.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.tokens import word_ids

CAPACITY, END_ID = 4096, 2
BLOCK_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_tokens bigint, sequence_cost double"
)


def cost(length: int) -> float:
    """Estimated attention cost of a piece: linear plus quadratic."""
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """(pieces, sequence lengths); a piece is (document, start, length, sequence, offset).

    ``lengths`` in the order that breaks ties.  ``capacity`` is a power of two.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    fills: list[int] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            pieces.append((d, at, capacity, len(fills), 0))
            fills.append(capacity)
            at += capacity
        if n > at:
            rest.append((n - at, d, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    full, tail = divmod(total, capacity)
    open_ = [(0.0, len(fills) + i) for i in range(full)]  # (cost, sequence): a heap
    room = {s: capacity for _, s in open_}
    now = dict.fromkeys(room, 0.0)  # the cost of each open sequence; heap entries of another cost are stale
    every = list(open_)
    # How many open sequences have each room, and the most that any has.
    held = [0] * (capacity + 1)
    held[capacity] = len(open_)
    most = capacity if open_ else 0
    # Sequences without room for the last remainder wait, by room, until remainders are that short.
    parked: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    below = 0
    fills += [capacity] * full
    small = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if tail >> b & 1]
    for n, d, at in rest:
        while n:
            while most and not held[most]:
                most -= 1
            if not most:
                # Only the powers of two are left; each is filled before the next opens.
                s = len(fills)
                fills.append(small.pop(0))
                room[s] = most = fills[-1]
                now[s] = 0.0
                held[most] += 1
                heapq.heappush(open_, (0.0, s))
                heapq.heappush(every, (0.0, s))
            if n <= most:
                for r in range(n, below):
                    for x in parked[r]:
                        heapq.heappush(open_, x)
                    parked[r] = []
                below = min(below, n)
                was, s = heapq.heappop(open_)
                while now.get(s) != was or room[s] < n:
                    if now.get(s) == was:
                        parked[room[s]].append((was, s))
                        below = max(below, n)
                    was, s = heapq.heappop(open_)
            else:
                was, s = heapq.heappop(every)
                while now.get(s) != was:
                    was, s = heapq.heappop(every)
            take = min(n, room[s])
            pieces.append((d, at, take, s, fills[s] - room[s]))
            held[room[s]] -= 1
            room[s] -= take
            if room[s]:
                held[room[s]] += 1
                now[s] = was + cost(take)
                heapq.heappush(open_, (now[s], s))
                heapq.heappush(every, (now[s], s))
            else:
                del now[s]
            n, at = n - take, at + take
    return pieces, fills


def _block(ids: list[int | None], tokens: list[bytes], first: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
    pieces, fills = assign([len(tokens[i]) // 4 for i in order], capacity)
    costs = [0.0] * len(fills)
    for _, _, n, s, _ in pieces:
        costs[s] += cost(n)
    columns: list[list] = [[] for _ in range(9)]
    for d, at, n, s, offset in pieces:
        i = order[d]
        row = (
            ids[i], at, n, zlib.crc32(memoryview(tokens[i])[4 * at : 4 * (at + n)]), len(tokens[i]) // 4,
            first + s, offset, fills[s], costs[s],
        )
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.float64()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names), len(fills)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text)."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    model = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, "rb").read())  # a file of fixed size
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(model.value)
        first = TaskContext.get().partitionId() << 42
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                tokens.append(encode.all(text.as_py() or "") + end)
                held += len(tokens[-1]) // 4
                if held >= block_tokens:
                    out, n = _block(ids, tokens, first, capacity)
                    yield out
                    first, ids, tokens, held = first + n, [], [], 0
        if ids:
            yield _block(ids, tokens, first, capacity)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
