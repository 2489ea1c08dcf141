"""Results of concurrent work put back in order, one group at a time, with bounded memory.

Items end in any order.  Those that wait for an earlier one lie in the state
store (RocksDB, on disk and checkpointed), in parts by blocks of item numbers;
memory holds ``CHUNK`` items that have just come and the block at hand.  An item
may have no rows: it still lets its successors go.  A repeated item counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "stage string, item bigint, row bigint, payload string, position bigint, waited boolean"
OVERDUE_MS = 3_600_000
#: Items that are taken in at once, and items of a block.  The store is asked once for a block, not for an item.
CHUNK, BLOCK = 4_096, 4_096


class InOrder(StatefulProcessor):
    """Releases the rows of item 0, 1, 2, ... of a stage as soon as all before them have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("next", "item bigint, position bigint")
        self.parts = handle.getMapState("parts", "block bigint", "parts int")
        self.waiting = handle.getMapState("waiting", "block bigint, part int", "items array<bigint>, payloads array<array<string>>")

    def _taken(self, block: int) -> dict[int, tuple[list[str], bool]]:
        """(payloads, True) of a block's items, which leave the store; of a repeated item the first."""
        found: dict[int, tuple[list[str], bool]] = {}
        if self.parts.containsKey((block,)):
            for part in range(self.parts.getValue((block,))[0]):
                items, payloads = self.waiting.getValue((block, part))
                for item, rows in zip(items, payloads, strict=True):
                    found.setdefault(item, (list(rows), True))
                self.waiting.removeKey((block, part))
            self.parts.removeKey((block,))
        return found

    def _put(self, block: int, items: dict[int, tuple[list[str], bool]]) -> None:
        part = self.parts.getValue((block,))[0] if self.parts.containsKey((block,)) else 0
        self.waiting.updateValue((block, part), (list(items), [rows for rows, _ in items.values()]))
        self.parts.updateValue((block,), (part + 1,))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        item, position = self.state.get() if self.state.exists() else (0, 0)
        at, here = item // BLOCK, self._taken(item // BLOCK)
        rows = iter(rows)
        while chunk := list(islice(rows, CHUNK)):
            new: dict[int, dict[int, tuple[list[str], bool]]] = {}
            for row in chunk:
                if row.item >= item:
                    new.setdefault(row.item // BLOCK, {}).setdefault(row.item, (list(row.payloads), False))
            while True:
                for i, found in new.pop(at, {}).items():
                    here.setdefault(i, found)
                while item in here:
                    payloads, waited = here.pop(item)
                    for n, payload in enumerate(payloads):
                        yield Row(stage=key[0], item=item, row=n, payload=payload, position=position, waited=waited)
                        position += 1
                    item += 1
                if item // BLOCK == at:
                    break
                at, here = item // BLOCK, self._taken(item // BLOCK)
            for block, items in new.items():
                self._put(block, items)
        if here:
            self._put(at, here)
        self.state.update((item, position))

    def close(self) -> None:
        pass


def in_order(items: DataFrame, stage: str = "stage", item: str = "item", payloads: str = "payloads") -> DataFrame:
    """stage, item, row, payload, position (from 0, without gaps), waited (whether the state store held it).

    ``items``: a stream with one row for each finished item and its payloads
    (array<string>).  The session must keep state in RocksDB (``STORE``).
    """
    rows = items.select(F.col(stage).alias("stage"), F.col(item).cast("bigint").alias("item"), F.coalesce(F.col(payloads), F.array().cast("array<string>")).alias("payloads"))
    return rows.groupBy("stage").transformWithState(InOrder(), OUT, "Append", "None")
