"""Chat formatting by token-level assembly.

A conversation's turns become one id sequence: role and text of each turn are
encoded separately with a byte-level tokenizer, and reserved ids beyond its
vocabulary are spliced in for the control strings, so no text can produce them.
Segment lengths, summed up, give the loss mask (assistant texts alone).  The
same template as a string is

    ### role\\n text \\n</turn>\\n

where control strings inside a text are escaped by one more backslash, which
``unescape`` takes away again.

Turns are gathered by conversation (one output row each) after their text has
been reduced to one struct per turn; turns are ordered by turn, role and text.
Null roles and texts count as empty, rows without conv_id form one
conversation, repeated turns are kept, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import byte_bpe

OPEN, CLOSE = "###", "</turn>"
CONTROL = re.compile(r"###|</turn>")
ESCAPED = re.compile(r"\\(?=###|</turn>)")
FORMATTED = "conv_id bigint, n_turns bigint, formatted string, ids array<int>, loss array<boolean>"
DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_tokens bigint"
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub("", text)


def _role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def as_string(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{OPEN} {_role(role)}\n{escape(text)}\n{CLOSE}\n" for role, text in turns)


class Assembler:
    """Ids from ``first_reserved`` are the control strings: open, between role and text, close."""

    def __init__(self, ranks: bytes, pattern: str, first_reserved: int):
        self.tokenizer = byte_bpe(ranks, pattern)
        if first_reserved < self.tokenizer.n_vocab:
            raise ValueError("reserved ids must lie beyond the vocabulary")
        self.open, self.between, self.close = (first_reserved + i for i in range(3))

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask)."""
        segments: list[list[int]] = []
        loss: list[bool] = []
        for role, text in turns:
            segments += [
                [self.open], self.tokenizer.encode_ordinary(role), [self.between],
                self.tokenizer.encode_ordinary(escape(text)), [self.close],
            ]
            loss += [False, False, False, role == "assistant", False]
        ends = np.cumsum([0, *map(len, segments)])
        # +1 where a loss segment starts, -1 where it ends; the prefix sum is the mask.
        edges = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(edges, ends[:-1][loss], 1)
        np.add.at(edges, ends[1:][loss], -1)
        ids = np.fromiter((i for s in segments for i in s), np.int32, ends[-1])
        return ids, np.cumsum(edges)[:-1] > 0

    def _text(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode_bytes(ids.tolist()).decode()

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """The turns, read back from the ids."""
        starts, middles, ends = (np.flatnonzero(ids == x) for x in (self.open, self.between, self.close))
        return [
            (self._text(ids[a + 1 : b]), unescape(self._text(ids[b + 1 : c])))
            for a, b, c in zip(starts, middles, ends, strict=True)
        ]

    def loss_text(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """All text under the mask, unescaped, read run by run."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        return "".join(unescape(self._text(ids[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the string."""
    found = re.findall(r"(?:^|(?<=\n</turn>\n))### ([^\n]*)\n(.*?)\n</turn>\n(?=### |\Z)", formatted, re.S)
    undo = lambda r: re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(r))
    return [(undo(role), unescape(text)) for role, text in found]


def _gather(conversations: DataFrame) -> DataFrame:
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _run(conversations: DataFrame, ranks_path: str, pattern: str, first_reserved: int, schema: str, row) -> DataFrame:
    model = conversations.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Assembler(model.value, pattern, first_reserved)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for key, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows.append({"conv_id": key} | row(maker, [(t["role"], t["text"]) for t in turns]))
                yield pa.RecordBatch.from_pylist(rows, arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    return _gather(conversations).mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, ranks_path: str, pattern: str, first_reserved: int = 50257) -> DataFrame:
    """conv_id, n_turns, formatted, ids and loss (one flag per id)."""

    def row(maker: Assembler, turns: list[tuple[str, str]]) -> dict:
        ids, mask = maker.assemble(turns)
        return {"n_turns": len(turns), "formatted": as_string(turns), "ids": ids.tolist(), "loss": mask.tolist()}

    return _run(conversations, ranks_path, pattern, first_reserved, FORMATTED, row)


def digest(conversations: DataFrame, ranks_path: str, pattern: str, first_reserved: int = 50257) -> DataFrame:
    """What the formatted output says of each conversation, read back from its ids."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def row(maker: Assembler, turns: list[tuple[str, str]]) -> dict:
        ids, mask = maker.assemble(turns)
        back, loss = maker.turns(ids), maker.loss_text(ids, mask)
        return {
            "n_turns": len(back),
            "turns_sha256": sha("".join(f"{role}\n{text}\n" for role, text in back)),
            "loss_chars": len(loss),
            "loss_sha256": sha(loss),
            "formatted_chars": len(as_string(turns)),
            "n_tokens": len(ids),
        }

    return _run(conversations, ranks_path, pattern, first_reserved, DIGEST, row)
