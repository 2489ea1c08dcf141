"""Huge JSON files, one value at a time.

Spark lists the files and deals them to tasks by size; a task reads a file in
chunks and holds one value, the open containers and their keys, never the file.
Objects and arrays are opened down to ``depth``; what lies deeper comes whole.
A key that an object repeats, at any depth, refuses the file, with the place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS, MOST_VALUE_CHARS = 1 << 16, 16_000_000
SCHEMA = "file string, place bigint, pointer string, value string, issue string"
TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s{}\[\]:,"]+))')


class Refused(ValueError):
    """Why and where (a JSON pointer) a file is refused."""

    def __init__(self, issue: str, pointer: str):
        super().__init__(f"{issue} at {pointer or '/'}")
        self.issue, self.pointer = issue, pointer


class _Open:
    """An open object (with its keys so far) or array."""

    def __init__(self, kind: str):
        self.kind = kind
        self.keys: set[str] = set()
        self.at: str | int = "" if kind == "{" else 0


def _pointer(stack: list[_Open]) -> str:
    return "".join("/" + str(x.at).replace("~", "~0").replace("/", "~1") for x in stack)


def tokens(read: Callable[[int], str], most: int = MOST_VALUE_CHARS, chunk: int = CHUNK_CHARS) -> Iterator[str]:
    """The tokens of a JSON text that ``read(n)`` gives in pieces.  A token that a piece ends in is looked at
    again with twice as much, so that long strings take linear time."""
    text, at, ended = read(chunk), 0, False
    while True:
        found = TOKEN.match(text, at)
        if not ended and (found is None or found.end() == len(text)):
            more = read(max(chunk, len(text) - at))
            ended = not more
            text, at = text[at:] + more, 0
            if len(text) > 2 * (most + chunk):
                raise Refused("value_too_large", "")
        elif found is None:
            if text[at:].strip(" \t\r\n"):
                raise Refused("invalid_json", "")
            return
        else:
            at = found.end()
            yield found.group().lstrip(" \t\r\n")


def values(read: Callable[[int], str], depth: int = 2, most: int = MOST_VALUE_CHARS, chunk: int = CHUNK_CHARS) -> Iterator[tuple[str, str]]:
    """(pointer, JSON text) of each value at ``depth`` and of each scalar above it, in order."""
    stack: list[_Open] = []
    parts: list[str] = []
    size, want, fresh = 0, "value", False
    try:
        for token in tokens(read, most, chunk):
            if len(token) > most:
                raise Refused("value_too_large", _pointer(stack))
            if len(stack) >= depth and (parts or want == "value"):
                closes_outer = len(stack) == depth and token in "]}" and not parts
                if not closes_outer:
                    parts.append(token)
                    size += len(token)
                    if size > most:
                        raise Refused("value_too_large", _pointer(stack))
            done = False
            if want == "end":
                raise Refused("invalid_json", "")
            if want == "colon" and token == ":":
                want = "value"
            elif want == "key" and token[0] == '"':
                key = json.loads(token)
                stack[-1].at = key
                if key in stack[-1].keys:
                    raise Refused("duplicate_key", _pointer(stack))
                stack[-1].keys.add(key)
                want = "colon"
            elif want == "value" and token in "{[":
                stack.append(_Open(token))
                want, fresh = ("key" if token == "{" else "value"), True
                continue
            elif token in "}]" and stack and stack[-1].kind + token in ("{}", "[]") and (want == "next" or fresh):
                stack.pop()
                done = True
            elif want == "next" and token == ",":
                if stack[-1].kind == "[":
                    stack[-1].at += 1
                want = "key" if stack[-1].kind == "{" else "value"
            elif want == "value" and token not in ",:}]":
                json.loads(token, parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
                done = True
            else:
                raise Refused("invalid_json", _pointer(stack))
            fresh = False
            if done:
                want = "next" if stack else "end"
                scalar = token not in "}]"
                if parts and len(stack) == depth:
                    yield _pointer(stack), "".join(parts)
                    parts, size = [], 0
                elif scalar and len(stack) < depth:
                    yield _pointer(stack), token
    except UnicodeDecodeError:
        raise Refused("invalid_encoding", _pointer(stack)) from None
    except ValueError as e:
        raise e if isinstance(e, Refused) else Refused("invalid_json", _pointer(stack)) from None
    if want != "end":
        raise Refused("invalid_json", _pointer(stack))


def opened(path: str) -> pa.PythonFile:
    """A readable stream of a path as Spark names it."""
    store, name = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
    return store.open_input_stream(name)


def huge_json(spark: SparkSession, path: str, depth: int = 2, most: int = MOST_VALUE_CHARS, pattern: str = "*") -> DataFrame:
    """file, place, pointer, value, issue of all files under ``path``.

    A refused file ends with a row of its own: its issue and the place.  Rows
    before it were read without holding the file; ``accepted`` drops them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64()] + [pa.string()] * 3

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held, place = [], 0, 0
                with io.TextIOWrapper(opened(file), "utf-8-sig") as text:
                    try:
                        for pointer, value in values(text.read, depth, most):
                            rows.append((file, place, pointer, value, None))
                            place, held = place + 1, held + len(value)
                            if held > CHUNK_CHARS:
                                yield table(rows)
                                rows, held = [], 0
                    except Refused as e:
                        rows.append((file, place, e.pointer, None, e.issue))
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(run, SCHEMA)


def accepted(rows: DataFrame) -> DataFrame:
    """The values of files that were not refused."""
    bad = rows.filter(F.col("issue").isNotNull()).select("file")
    return rows.join(bad, "file", "left_anti").drop("issue")
