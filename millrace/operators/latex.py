"""LaTeX texts in chunks that cut no formula, table, literal block, definition or command.

Brackets and environments are paired once over the whole text; what must stay
whole becomes a list of intervals, the outermost only; a chunk ends between them.
Linear in the text but for the search of the interval at a place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Environments whose content is literal, other environments that stay whole, and definitions.
LITERAL = {"verbatim", "verbatim*", "Verbatim", "lstlisting", "minted"}
WHOLE = LITERAL | {
    "equation", "equation*", "align", "align*", "aligned", "alignat", "alignat*", "gather", "gather*", "gathered",
    "multline", "multline*", "flalign", "flalign*", "eqnarray", "eqnarray*", "displaymath", "math", "split", "array",
    "tabular", "tabular*", "tabularx", "longtable", "table", "table*", "figure", "figure*",
    "cases", "matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "smallmatrix", "tikzpicture", "picture",
}
DEFINES = {
    "newcommand", "renewcommand", "providecommand", "DeclareRobustCommand", "DeclareMathOperator",
    "newenvironment", "renewenvironment", "provideenvironment",
}
SHORT_DEFINES = {"def", "gdef", "edef", "xdef"}

SIGN = re.compile(r"\\(?P<name>(?:[^\W\d_]|@)+|.|\Z)|(?P<bracket>[{}\[\]])|(?P<math>\$)", re.S)
BLANKS = re.compile(r"\s*")


class LatexError(ValueError):
    """What keeps a text from being cut safely."""


class _Text:
    def __init__(self, text: str):
        self.text = text
        self.signs = list(SIGN.finditer(text))
        self.starts = [s.start() for s in self.signs]
        self.closes: dict[int, int] = {}
        waiting: dict[str, list[int]] = {"{": [], "[": []}
        for s in self.signs:
            b = s["bracket"]
            if b in waiting:
                waiting[b].append(s.start())
            elif b and waiting["{" if b == "}" else "["]:
                self.closes[waiting["{" if b == "}" else "["].pop()] = s.end()
        self.ends = self._environments()

    def group(self, at: int, bracket: str = "{") -> int | None:
        """The end of the bracketed group that follows ``at``, after blanks; None if there is none."""
        at = BLANKS.match(self.text, at).end()
        if not self.text.startswith(bracket, at):
            return None
        if at not in self.closes:
            raise LatexError("latex_unbalanced_group")
        return self.closes[at]

    def named(self, at: int) -> tuple[str, int] | None:
        """The content of the group after ``at`` and its end."""
        end = self.group(at)
        return None if end is None else (self.text[self.text.index("{", at) + 1 : end - 1], end)

    def _literal(self, name: str, end: int) -> int | None:
        if name == "verb":
            end += self.text.startswith("*", end)
            mark = self.text[end : end + 1]
            close = self.text.find(mark, end + 1) if mark and not mark.isspace() else -1
            if close < 0 or "\n" in self.text[end:close]:
                raise LatexError("latex_invalid_verbatim")
            return close + 1
        block = self.named(end) if name == "begin" else None
        if block and block[0] in LITERAL | {"comment"}:
            last = f"\\end{{{block[0]}}}"
            close = self.text.find(last, block[1])
            if close < 0:
                raise LatexError("latex_invalid_verbatim")
            return close + len(last)
        return None

    def _definition(self, name: str, end: int) -> int | None:
        if name in DEFINES:
            at = end + self.text.startswith("*", end)
            what = self.group(at)
            if what is None:
                at = BLANKS.match(self.text, at).end()
                sign = SIGN.match(self.text, at) if self.text.startswith("\\", at) else None
                if sign is None:
                    return None
                what = sign.end()
            at = what
            for _ in range(2):
                at = self.group(at, "[") or at
            for _ in range(2 if name.endswith("environment") else 1):
                at = self.group(at)
                if at is None:
                    return None
            return at
        if name in SHORT_DEFINES:
            at = BLANKS.match(self.text, end).end()
            if not self.text.startswith("\\", at):
                return None
            body = re.compile(r"[{\n]").search(self.text, SIGN.match(self.text, at).end())
            return self.group(body.start()) if body else None
        return None

    def _environments(self) -> dict[int, int | None]:
        """Begin of each environment that stays whole -> its end (None: it has none), by a stack for each name."""
        ends: dict[int, int | None] = {}
        open_: dict[str, list[int]] = {}
        until = 0
        for s in self.signs:
            name = s["name"]
            if name is None or s.start() < until:
                continue
            skip = self._literal(name, s.end()) or self._definition(name, s.end())
            if skip is not None:
                until = skip
            elif name in ("begin", "end") and (block := self.named(s.end())) and block[0] in WHOLE:
                if name == "begin":
                    open_.setdefault(block[0], []).append(s.start())
                    ends[s.start()] = None
                elif open_.get(block[0]):
                    ends[open_[block[0]].pop()] = block[1]
        return ends

    def _math(self, at: int, close: str) -> int:
        """The end of a formula whose inside begins at ``at``; commands inside hide their own characters."""
        for i in range(bisect_left(self.starts, at), len(self.starts)):
            s = self.signs[i]
            if s.group() == close or (s["math"] and self.text.startswith(close, s.start())):
                return s.start() + len(close)
        raise LatexError("latex_unclosed_math")

    def atoms(self) -> list[tuple[int, int]]:
        """The intervals that stay whole, outermost only, in order."""
        out: list[tuple[int, int]] = []
        until = 0
        for s in self.signs:
            start, end, name = s.start(), s.end(), s["name"]
            if start < until or s["bracket"]:
                continue
            if name is None:
                close = "$$" if self.text.startswith("$$", start) else "$"
                until = self._math(start + len(close), close)
            else:
                found = self._literal(name, end) or self._definition(name, end)
                if found is None and start in self.ends:
                    found = self.ends[start]
                    if found is None:
                        raise LatexError("latex_unclosed_environment")
                if found is None and name in ("[", "("):
                    found = self._math(end, "\\]" if name == "[" else "\\)")
                until = found or self._arguments(name, end)
            out.append((start, until))
        return out

    def _arguments(self, name: str, end: int) -> int:
        at = end + self.text.startswith("*", end)
        if not name[:1].isalpha():
            return end
        at = self.group(at, "[") or at
        while (more := self.group(at)) is not None:
            at = more
        return at


def chunks(text: str, target: int = 2000) -> list[str]:
    """Chunks of about ``target`` characters at most; an interval that is longer stays one."""
    atoms = _Text(text).atoms()
    begins = [a for a, _ in atoms]

    def around(at: int, its_end: bool = False) -> tuple[int, int] | None:
        i = bisect_right(begins, at) - 1
        return atoms[i] if i >= 0 and begins[i] < at and (at < atoms[i][1] or (its_end and at == atoms[i][1])) else None

    gaps = [m.start() for m in re.finditer(r"\s+", text) if not around(m.start())]
    out, start = [], BLANKS.match(text).end()
    while start < len(text):
        end = min(len(text), start + target)
        if crossed := around(end):
            end = crossed[0] if crossed[0] > start else crossed[1]
        if end < len(text) and not around(end, its_end=True):
            last = bisect_left(gaps, end) - 1
            if last >= 0 and gaps[last] > start:
                end = gaps[last]
        out.append(text[start:end].strip())
        start = BLANKS.match(text, end).end()
    return [x for x in out if x]


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 2000) -> DataFrame:
    """key, chunk (from 0), text, issue: the chunks of each text, or one row with what is wrong with it.
    Null and blank texts give no rows."""
    if target < 1:
        raise ValueError("invalid_latex_chunk_size")

    @F.pandas_udf("chunks array<string>, issue string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((chunks(t or "", target), None))
            except LatexError as e:
                rows.append(([None], str(e)))
        return pd.DataFrame(rows, columns=["chunks", "issue"])

    found = docs.select(key, run(F.col(text)).alias("_r"))
    return found.select(key, "_r.issue", F.posexplode("_r.chunks").alias("chunk", "text")).select(key, "chunk", "text", "issue")
