"""Toxicity scoring behind a noisy-channel deobfuscator.

1. Language model.  Letter trigrams of all texts, labelled or not; letters beyond
   the Latin ones up to U+017F count as one, so the model is of bounded size.
2. Channel.  A text is a lattice: a letter stands for itself or repeats the one
   before; a digit or symbol stands for the letters it imitates or for itself,
   which ends a word; what else is between letters (blanks, separators,
   punctuation) ends a word or is dropped.  ``Model.restore`` finds the likeliest
   words by Viterbi over all states, without a beam.
3. Scorer.  Words and pairs of words of the restored text that a bounded
   hash-ordered sample of labelled rows ties to the label (by a likelihood-ratio
   test; labels of fold 0 are never read): naive Bayes over what is present, each
   phrase by its log-odds less their standard error, with the labels' prior
   less ``CAUTION``.

Where a phrase of the scorer can be read at all, its skeleton (classes of letters
that some symbol can stand for alike, repeats folded, all else dropped) occurs in
the text's skeleton.  So only spans below such an occurrence are decoded, whole
tokens each: no reading of a phrase is lost, whatever imitates, parts or repeats
its letters, across tokens too.

Scoring is one pass without a shuffle.  Null and empty texts score by the prior
alone; texts are read whole; null ids and repeated rows are carried along and not
held out or scored each; an empty table gives no rows; extra columns are ignored.
Without labelled rows of both kinds every score is the prior, 0.5 if there is none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored
from millrace.llm.training import MAX_LABELLED, fold, labelled_sample, one_of_each

# Letters that digits and symbols imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e",
}
SEPARATORS = " .-_*~"
#: Decoration at a token's ends.
EDGE = ".,;:?\"'()#*&%<>!“”„‘’«»¡¿…[]{}"
DOUBLE = re.compile(r"(.)\1+")
#: Letters alone, none three times in a row: read as they stand, or as Viterbi says.
UNDISGUISED = re.compile(r"(?:([^\W\d_])(?!\1\1)|\s)+")
PLAIN = re.compile(r"(?<![\w@$!|+])[^\W\d_]+(?![\w@$!|+])")
WORD = re.compile(r"[^\W\d_]+")
#: A token whose lattice has more than one path.
TWOFOLD = re.compile(r"[0-9@$!|+€]|([^\W\d_])\1|[^\W\d_][^\w\s]+[^\W\d_]")
#: Letters beyond the Latin ones.
OTHER = "□"
#: Channel costs in nats: an imitation, a separator dropped, other punctuation dropped, a repeat, a
#: symbol that stands for itself, a blank dropped between words, a word end between spaced letters.
C_IMITATE, C_DROP, C_PUNCTUATION, C_REPEAT, C_LITERAL, C_JOIN, C_BREAK = 0.5, 0.2, 6.0, 2.0, 2.0, 3.0, 1.0
MIN_DOCS = 4
#: Nats in favour of clean documents.
CAUTION = 1.0
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def _classes() -> np.ndarray:
    """Class number by code point, 0 where the skeleton has nothing; the last entry is for all beyond."""
    out = np.zeros(0x180 + 1, np.uint8)
    for ch in map(chr, range(0x180)):
        if ch.isalpha() and not ch.isupper():
            out[ord(ch)] = 1 + (ord(ch) - 97 if ch < "{" else 27 + (ord(ch) - 0xAA) % 226)
    same = {x: min(xs) for xs in IMITATES.values() for x in xs}
    for x, least in same.items():
        out[ord(x)] = out[ord(least)]
    for symbol, letters in IMITATES.items():
        if ord(symbol) < 0x180:
            out[ord(symbol)] = out[ord(min(letters))]
    return out


CLASSES = _classes()
_BEYOND = np.uint8(255)


def skeleton(low: str) -> tuple[str, np.ndarray]:
    """(classes of a lower-case text with repeats folded, the places of their first characters)."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    found = CLASSES[np.minimum(codes, 0x180)]
    if not low.isascii():
        for at in np.flatnonzero(codes >= 0x180):
            if low[at] == "€":
                found[at] = CLASSES[ord("e")]
            elif low[at].isalpha():
                found[at] = _BEYOND
    at = np.flatnonzero(found)
    kept = found[at]
    new = np.ones(len(kept), bool)
    new[1:] = kept[1:] != kept[:-1]
    return kept[new].tobytes().decode("latin-1"), at[new]


def letters(word: str) -> str:
    """A word in the language model's alphabet."""
    return word if word.isascii() else "".join(x if x < "ƀ" else OTHER for x in word)


@dataclass
class Model:
    """Trigram counts of letters (``^`` starts and ``$`` ends a word), weights of phrases and the bias."""

    grams: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def __post_init__(self) -> None:
        self.contexts = Counter()
        for g, n in self.grams.items():
            self.contexts[g[:2]] += n
        self._alphabet = 1 + len({g[2] for g in self.grams})
        self._memo: dict[str, str] = {}
        by: dict[str, list[str]] = {}
        for phrase in self.weights:
            by.setdefault(skeleton(phrase)[0], []).append(phrase)
        self._automaton = None
        if by:
            self._automaton = ahocorasick.Automaton()
            for shape, phrases in by.items():
                self._automaton.add_word(shape, (len(shape), phrases))
            self._automaton.make_automaton()

    def cost(self, context: str, ch: str) -> float:
        """Nats of a letter after two others, smoothed over the alphabet."""
        return -math.log((self.grams.get(context + ch, 0) + 0.1) / (self.contexts.get(context, 0) + 0.1 * self._alphabet))

    def arcs(self, span: str, i: int, context: str) -> Iterator[tuple[str, float, str]]:
        """(next context, cost, what is written) of the character at ``i`` after ``context``."""
        ch = span[i]
        if ch in IMITATES or ch.isalpha():
            for x in IMITATES.get(ch, ch):
                x = x if x < "ƀ" else OTHER
                price = C_IMITATE if ch in IMITATES else 0.0
                yield context[1] + x, price + self.cost(context, x), x
                if x == context[1]:
                    yield context, price + C_REPEAT, ""
            if ch.isalpha():
                return
            stop, drop = C_LITERAL, None
        elif ch.isspace():
            lone = (i < 2 or span[i - 2].isspace()) and (i + 2 >= len(span) or span[i + 2].isspace())
            wide = span[i - 1].isspace() or span[i + 1 : i + 2].isspace()
            stop, drop = (C_BREAK, C_DROP) if lone and not wide else (0.0, C_JOIN)
        else:
            stop, drop = 0.0, C_DROP if ch in SEPARATORS else C_PUNCTUATION
        if context == "^^":
            yield context, 0.0, ""
            return
        yield "^^", stop + self.cost(context, "$"), " "
        if drop is not None:
            yield context, drop, ""

    def _viterbi(self, span: str) -> str:
        states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        for i in range(len(span)):
            best: dict[str, tuple[float, str]] = {}
            for context, (c, out) in states.items():
                for to, price, text in self.arcs(span, i, context):
                    new = (c + price, out + text)
                    if to not in best or new < best[to]:
                        best[to] = new
            states = best
        ends = [(c + (0.0 if s == "^^" else self.cost(s, "$")), out) for s, (c, out) in states.items()]
        return min(ends)[1].strip()

    def restore(self, span: str) -> str:
        """The likeliest words that a lower-case ``span`` obfuscates."""
        if (known := self._memo.get(span)) is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            known = self._viterbi(span)
            if len(span) <= 64:
                self._memo[span] = known
        return known

    def find(self, text: str) -> set[str]:
        """The weighted phrases in a restored text."""
        found: set[str] = set()
        if self._automaton is None:
            return found
        low = text.lower()
        shape, places = skeleton(low)
        for end, (size, phrases) in self._automaton.iter(shape):
            if found.issuperset(phrases):
                continue
            a, b = int(places[end - size + 1]), int(places[end + 1]) if end + 1 < len(places) else len(low)
            # Up to the next other letter only blanks and repeats follow; whole tokens are read.
            last = int(places[end])
            while last + 1 < b and not low[last + 1].isspace():
                last += 1
            if last + 1 == b and b < len(low) and not low[b].isspace():
                while last + 1 < len(low) and not low[last + 1].isspace():
                    last += 1
            elif last + 1 < b:
                last = self._repeats(low, last, b)
            while a and not low[a - 1].isspace():
                a -= 1
            found |= self._read(low[a : last + 1], phrases)
        return found

    def _repeats(self, low: str, last: int, b: int) -> int:
        """The end of single characters after ``last`` that repeat the one there."""
        at, own = last + 1, low[last].strip(EDGE)
        while own and at < b:
            m = re.compile(r"\s+(\S+)").match(low, at)
            if not m or m.end() > b or m[1].strip(EDGE) != own:
                break
            last, at = m.end() - 1, m.end()
        return last

    def _read(self, span: str, phrases: list[str]) -> set[str]:
        """Those of ``phrases`` that the likeliest words of ``span`` hold, decoration stripped or not."""
        found: set[str] = set()
        for body in {span, span.strip(EDGE), span.strip(EDGE + "$@+|")}:
            said = f" {self.restore(body)} "
            plain = f" {' '.join(WORD.findall(body))} "
            found |= {p for p in phrases if f" {letters(p)} " in said or f" {p} " in plain}
            if not UNDISGUISED.fullmatch(body):  # whether a letter was doubled before is unknown
                said = DOUBLE.sub(r"\1", said)
                found |= {p for p in phrases if f" {DOUBLE.sub(chr(92) + '1', letters(p))} " in said}
        return found

    def words(self, text: str) -> set[str]:
        """Plain words, restored tokens and runs of single characters, and weighted phrases."""
        low = text.lower()
        tokens = low.split()
        found = {w for t in set(tokens) for w in self.readings(t)}
        for run in re.findall(r"(?:(?<=\s)|^)\S(?:\s+\S){2,}(?=\s|$)", low):
            found |= set(self.restore(run).split())
            for part in re.split(r"\s{2,}", run):
                found |= set(self.restore(part).split())
        return found | self.find(text)

    def readings(self, token: str) -> set[str]:
        """The plain words in a lower-case token, and those that it obfuscates."""
        found = set(WORD.findall(token))
        bare = token.strip(EDGE)
        if len(bare) <= 64 and TWOFOLD.search(bare):
            found |= set(self.restore(bare).split())
        return found

    def score(self, text: str) -> float:
        x = self.bias + sum(self.weights[w] for w in sorted(self.find(text)))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def _counted(texts: Iterable[str]) -> Counter:
    grams: Counter = Counter()
    words: Counter = Counter()

    def add() -> None:
        for w, n in words.items():
            s = f"^^{letters(w)}$"
            for i in range(len(s) - 2):
                grams[s[i : i + 3]] += n
        words.clear()

    for text in texts:
        words.update(PLAIN.findall(text.lower()))
        if len(words) > 100_000:
            add()
    add()
    return grams


def language(docs: DataFrame) -> dict[str, int]:
    """Trigram counts over all ``docs``; the alphabet is bounded, so what reaches the driver is too."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _counted(t.as_py() or "" for b in batches for t in b.column(0))
        yield pa.RecordBatch.from_pydict({"gram": list(found), "n": list(found.values())}, pa.schema([("gram", pa.string()), ("n", pa.int64())]))

    counts = docs.select("text").mapInArrow(grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return dict(sorted((r.gram, r.n) for r in counts.collect()))


def phrases_of(text: str, decoder: Model) -> set[str]:
    """Words and pairs of neighbouring words of a text whose tokens are restored one by one."""
    said: list[str] = []
    found: set[str] = set()
    for token in text.lower().split():
        bare = token.strip(EDGE)
        plain = WORD.findall(bare)
        read = decoder.restore(bare).split() if len(bare) <= 64 and TWOFOLD.search(bare) else plain
        found.update(plain, read)
        said += read
    found.update(f"{a} {b}" for a, b in zip(said, said[1:], strict=False))
    return found


def _tallied(rows: DataFrame, grams: dict[str, int], among: set[str] | None) -> DataFrame:
    """phrase, n: in how many of ``rows`` (text) each phrase (of ``among``) occurs."""
    sent = rows.sparkSession.sparkContext.broadcast((grams, among))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wanted = sent.value
        decoder, found = Model(counts), Counter()
        for b in batches:
            for text in b.column(0):
                said = phrases_of(text.as_py() or "", decoder)
                found.update(said if wanted is None else said & wanted)
        yield pa.RecordBatch.from_pydict({"phrase": list(found), "n": list(found.values())}, pa.schema([("phrase", pa.string()), ("n", pa.int64())]))

    return rows.select("text").mapInArrow(run, "phrase string, n bigint").groupBy("phrase").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Trigrams of all ``docs``; phrases, weights and bias of at most ``limit`` labelled rows, which
    also bound all that reaches the driver."""
    grams = language(docs)
    sample = labelled_sample(docs, labels, "toxic", limit)
    rows = stored(one_of_each(sample).select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") != 0).cast("int").alias("toxic")))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(grams)
    bad = {r.phrase: r.n for r in _tallied(rows.filter("toxic = 1"), grams, None).filter(F.col("n") >= MIN_DOCS).collect()}
    good = {r.phrase: r.n for r in _tallied(rows.filter("toxic = 0"), grams, set(bad)).collect()}
    least, prior = math.log(len(bad) + 1) + 1.0, toxic / (toxic + clean)
    chosen: dict[str, float] = {}
    for phrase, t in bad.items():
        c = good.get(phrase, 0)
        # A phrase enters only if its split is unlikely by chance among so many phrases.
        gain = t * math.log(t / ((t + c) * prior)) + (c * math.log(c / ((t + c) * (1 - prior))) if c else 0.0)
        if t / (t + c) > prior and gain >= least:
            chosen[phrase] = math.log((t + 0.25) / (toxic + 0.5)) - math.log((c + 0.25) / (clean + 0.5)) - 1 / math.sqrt(t)
    return Model(grams, dict(sorted(chosen.items())), math.log(toxic / clean) - CAUTION)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.grams, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            scores = [own.score(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, SCHEMA)
