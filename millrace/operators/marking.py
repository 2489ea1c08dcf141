"""Control phrases in reasoning, marked by tags or replaced for a target, by a table of literal rules.

The table is checked once; texts are scanned once, longest literal first, within
a prefix that existing pairs of tags do not use up, so nothing that is put in
can set off another rule.  Pairs already there are kept; a tag that has no
partner is an issue of its row, and the row's text stays as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed names of tags, the limits of the prefix and its usual length.
TAG_NAME = r"[A-Za-z][A-Za-z0-9_-]{0,63}"
LEAST_PREFIX, MOST_PREFIX, PREFIX, TAG = 64, 2048, 512, "reason-strength"

NOTE = "struct<start:bigint,end:bigint,original:string,marker:string,rule_id:string,replacement:string>"
MARKED = f"text string, notes array<{NOTE}>, replacements bigint, issue string"


class Rule(NamedTuple):
    id: str
    matches: tuple[str, ...]
    marker: str
    replacement: str | None = None


class Note(NamedTuple):
    start: int
    end: int
    original: str
    marker: str
    rule_id: str
    replacement: str | None


def _literal(text: str) -> str:
    """``text`` as a whole word or number: 5 is not found in 50 or 5.0."""
    word = lambda c: c.isalnum() or c == "_"
    ends = (r"(?<!\w)" if word(text[0]) else "", r"(?!\w)" if word(text[-1]) else "", r"(?!\.\d)" if text[-1].isdigit() else "")
    return ends[0] + re.escape(text) + ends[1] + ends[2]


class Unpaired(ValueError):
    """A tag without its partner."""


class Marker:
    """The checked rules; small, and sent to the tasks as it is."""

    def __init__(self, rules: Iterable[Rule], tag: str = TAG, prefix: int = PREFIX):
        if not re.fullmatch(TAG_NAME, tag):
            raise ValueError("invalid_control_text_annotation_tag")
        if not LEAST_PREFIX <= prefix <= MOST_PREFIX:
            raise ValueError("invalid_control_text_prefix_limit")
        self.opening, self.closing, self.prefix = f"<{tag}>", f"</{tag}>", prefix
        self.rules = {r.id: r for r in rules}
        literals: list[tuple[str, str]] = []
        for r in self.rules.values():
            every = [*dict.fromkeys(r.matches), r.marker]
            if not r.id.strip() or any(not x.strip() for x in every) or (r.replacement is not None and not r.replacement.strip()):
                raise ValueError("invalid_control_text_rule")
            literals += [(x, r.id) for x in every]
        self.of = dict(literals)
        markers = {r.marker for r in self.rules.values()}
        inside = any(a in b for m in markers for x in self.of if x != m for a, b in ((m, x), (x, m)))
        tagged = any(t in x for x in self.of for t in (self.opening, self.closing))
        if len(self.of) < len(literals) or len(self.rules) < len(list(rules)) or inside or tagged:
            raise ValueError("control_text_rule_conflict")
        again = [r.replacement for r in self.rules.values() if r.replacement is not None]
        if any(x in put for put in again for x in (*self.of, self.opening, self.closing)):
            raise ValueError("control_text_replacement_cascade")
        ordered = sorted(self.of, key=lambda x: (-len(x), x))
        self.literal = re.compile("|".join(map(_literal, ordered)) if ordered else r"(?!)")
        self.tags = re.compile(f"{re.escape(self.opening)}|{re.escape(self.closing)}")

    def pairs(self, text: str) -> Iterator[tuple[int, int, int, re.Match | None]]:
        """(start, end, prefix used up before, known phrase inside or None) of each pair that begins in the prefix."""
        used, after, held = 0, 0, None
        for tag in self.tags.finditer(text):
            opens = tag.group() == self.opening
            if held is None:
                used += tag.start() - after
                if used >= self.prefix:
                    return
                if not opens:
                    raise Unpaired(tag.start())
                held = tag
            elif opens:
                if used + tag.start() - held.end() < self.prefix:
                    raise Unpaired(tag.start())
            else:
                known = self.literal.fullmatch(text[held.end() : tag.start()])
                yield held.start(), tag.end(), used, known
                # The tags of a known phrase are annotation and use nothing up.
                used += len(known.group()) if known else tag.end() - held.start()
                after, held = tag.end(), None
                if used >= self.prefix:
                    return
        if held is not None:
            raise Unpaired(held.start())

    def run(self, text: str, replace: bool) -> tuple[str, list[Note]]:
        out: list[str] = []
        notes: list[Note] = []

        def put(phrase: str, note_at: int, span: tuple[int, int]) -> None:
            rule = self.rules[self.of[phrase]]
            new = rule.replacement if replace else None
            begin, end = (note_at, note_at + len(phrase)) if new is None else span
            notes.append(Note(begin, end, text[begin:end], rule.marker, rule.id, new))
            out.append(f"{self.opening}{phrase}{self.closing}" if new is None else new)

        def plain(begin: int, end: int, used: int) -> None:
            copied = begin
            if used < self.prefix:
                # Literals are sought in the whole segment, so that its limit cuts none in two.
                for found in self.literal.finditer(text[begin:end]):
                    if found.end() > self.prefix - used:
                        break
                    at = begin + found.start()
                    out.append(text[copied:at])
                    put(found.group(), at, (at, at + len(found.group())))
                    copied = at + len(found.group())
            out.append(text[copied:end])

        after = used = 0
        for begin, end, before, known in self.pairs(text):
            plain(after, begin, before - (begin - after))
            if known and before + len(known.group()) <= self.prefix:
                put(known.group(), begin + len(self.opening), (begin, end))
            else:
                out.append(text[begin:end])
            after, used = end, before + (len(known.group()) if known else end - begin)
        plain(after, len(text), used)
        return "".join(out), notes


def _marked(texts: Column, marker: Marker, replace: bool) -> Column:
    @F.pandas_udf(MARKED)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for text in column:
            issue, out, notes = None, text, []
            if text is not None:
                try:
                    out, notes = marker.run(text, replace)
                except Unpaired:
                    issue = "control_text_unbalanced_tags"
            rows.append((out, [n._asdict() for n in notes], sum(n.replacement is not None for n in notes), issue))
        return pd.DataFrame(rows, columns=["text", "notes", "replacements", "issue"])

    return run(texts)


def mark(rows: DataFrame, marker: Marker, text: str = "text", into: str = "marked", replace: bool = False) -> DataFrame:
    """``rows`` with a struct ``into``: text, notes (the phrases found, by offsets in the text given),
    replacements, issue.  With ``replace``, phrases of rules that have a replacement give way to it.
    A null text stays null."""
    return rows.withColumn(into, _marked(F.col(text), marker, replace))


def task_references(rows: DataFrame, marker: Marker, task: str, notes: str = "marked.notes") -> Column:
    """Whether the task text ``task`` names a phrase or marker of a rule that fired on the row."""
    found = F.lit(False)
    for r in marker.rules.values():
        fired = F.exists(notes, lambda n: n["rule_id"] == r.id)  # noqa: B023
        pattern = "|".join(_java(x) for x in sorted({*r.matches, r.marker}, key=lambda x: (-len(x), x)))
        found = found | (fired & F.coalesce(F.col(task).rlike(f"(?U){pattern}"), F.lit(False)))
    return found


def _java(text: str) -> str:
    own = _literal(text)
    return own.replace(re.escape(text), r"\Q" + text + r"\E") if "\\E" not in text else own

