"""A stream over growing JSON-lines files whose offsets are byte positions.

The offset of a file is the end of its last complete line.  What follows (a
record that is still being written) is held back until its line ends, so a
restart anywhere, in the midst of a record too, loses and repeats nothing.
Ranges of a file are cut to ``RANGE_BYTES``; a range owns the lines that begin
in it, so one long file is read by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MOST_EVENT_BYTES, RANGE_BYTES = 65_536, 8 << 20


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)


def complete_until(file: pyarrow.NativeFile, size: int) -> int:
    """The position after the last newline among ``size`` bytes; 0 without one."""
    end = size
    while end:
        begin = max(0, end - MOST_EVENT_BYTES)
        file.seek(begin)
        at = file.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        if size - begin > MOST_EVENT_BYTES:
            raise ValueError("control_event_too_large")
        end = begin
    return 0


class Range(InputPartition):
    def __init__(self, path: str, first: int, begin: int, end: int):
        self.path, self.first, self.begin, self.end = path, first, begin, end


class ByteFeedReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> dict[str, int]:
        store, top = _store(self.path)
        found = store.get_file_info(pyarrow.fs.FileSelector(top, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.is_file and f.path.endswith(".jsonl")}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = _store(self.path)
        ends = {}
        for name, size in sorted(self._files().items()):
            with store.open_input_file(name) as file:
                ends[name] = complete_until(file, size)
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        sizes = self._files()
        out: list[InputPartition] = []
        for name, first in start.items():
            if first > sizes.get(name, 0):
                raise ValueError("invalid_event_cursor")
        for name, stop in end.items():
            first = start.get(name, 0)
            out += [Range(name, first, at, min(at + RANGE_BYTES, stop)) for at in range(first, stop, RANGE_BYTES)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as raw:
            at = partition.begin
            if at:
                # A line that began before this range belongs to the range before.
                raw.seek(at - 1)
                before = raw.read(1)
                if at == partition.first and before != b"\n":
                    raise ValueError("invalid_event_cursor")
                while before != b"\n" and at < partition.end:
                    block = raw.read(min(MOST_EVENT_BYTES, partition.end - at))
                    cut = block.find(b"\n")
                    at += len(block) if cut < 0 else cut + 1
                    before = b"" if cut < 0 else b"\n"
            held = b""
            position = at
            while position < partition.end or held:
                raw.seek(position + len(held))
                block = held + raw.read(1 << 20)
                lines = block.split(b"\n")
                held = lines.pop()
                for line in lines:
                    if position >= partition.end:
                        return
                    if len(line) >= MOST_EVENT_BYTES:
                        raise ValueError("control_event_too_large")
                    event = json.loads(line)
                    if not isinstance(event, dict):
                        raise ValueError("invalid_control_event")
                    yield partition.path, position, position + len(line) + 1, line.decode()
                    position += len(line) + 1
                if position >= partition.end:
                    return
                if len(held) > MOST_EVENT_BYTES:
                    raise ValueError("control_event_too_large")


class ByteFeed(DataSource):
    """``format("byte_feed")``; option ``path``: a folder of .jsonl files that grow at their ends."""

    @classmethod
    def name(cls) -> str:
        return "byte_feed"

    def schema(self) -> str:
        return "file string, position bigint, next_position bigint, event string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ByteFeedReader(self.options["path"])


def byte_feed(spark: SparkSession, path: str) -> DataFrame:
    """The stream of the events under ``path``: file, position, next_position, event (JSON)."""
    spark.dataSource.register(ByteFeed)
    return spark.readStream.format("byte_feed").option("path", path).load()
