"""Personal data in texts (native DataFrame functions only).

Regular expressions propose spans, checksums confirm them (Luhn for payment
cards, mod-97 for bank account numbers), and words near a span raise or lower
its score.  The base kinds are always kept, with their score; ``iban`` and
``ssn`` are reported only at ``MIN_SCORE`` or more.

Row-local: no shuffle.  Null texts count as empty; texts are read whole, in time
linear in their length; repeated rows give repeated findings; an empty table
gives no rows; other columns pass through, except those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import joined, matches, whole

# The base patterns with the same leftmost matches, in time linear in the text:
# a match can start only where its run starts or the last match ended (\G), and
# possessive quantifiers never give back what the next part cannot use.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A card match is a whole chain of digits joined by single spaces or hyphens.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Words that make a kind likelier when they stand within ``REACH`` code points.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank",
    "ssn": "ssn|social|security",
}
#: Words that make every kind less likely.
DOUBT = "example|sample|dummy|fake|test|version|serial|invoice"
#: Scores are hundredths.
PRIOR = {"email": 90, "ip": 60, "card": 80, "phone": 70, "iban": 70, "ssn": 30}
REACH, RAISE, LOWER, MIN_SCORE = 40, 30, 30, 50
BASE = ("email", "ip", "card", "phone")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    """Each part at most 255; leading zeros do not count, long parts fail."""
    return F.forall(
        F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    )


def mod97(hit: Column) -> Column:
    """The remainder of an account number: its first four characters go last, letters become 10 to 35."""
    flat = F.regexp_replace(hit, " ", "")
    moved = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v < 58, acc * 10 + v - 48).otherwise(acc * 100 + v - 55) % 97

    return F.aggregate(F.array_remove(F.split(moved, ""), ""), F.lit(0), step)


def _scored(text: Column, spans: Column, kind: str) -> Column:
    def one(s: Column) -> Column:
        near = F.substr(text, F.greatest(s["start"] - REACH, F.lit(0)).cast("int") + 1, (s["end"] - s["start"] + 2 * REACH).cast("int"))
        said = lambda words: near.rlike(rf"(?i)(?<![a-z])(?:{words})")
        change = F.when(said(CONTEXT[kind]), RAISE).otherwise(0) - F.when(said(DOUBT), LOWER).otherwise(0)
        score = F.least(F.lit(100), F.lit(PRIOR[kind]) + change)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    return F.transform(spans, one)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array<struct<kind,start,end,score (hundredths)>> column for each kind."""
    body = whole(F.col(text))
    n = lambda hit: F.length(_digits(hit))
    keep = {
        "email": None,
        "ip": _octets,
        "card": lambda h: F.call_function("luhn_check", _digits(h)),
        "phone": lambda h: n(h).between(8, 15),
        "iban": lambda h: mod97(h) == 1,
        "ssn": None,
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
    raw = docs.withColumns({f"__pii_{k}": matches(body, p, k, keep[k]) for k, p in patterns.items()})
    out = raw.withColumns({k: _scored(body, F.col(f"__pii_{k}"), k) for k in patterns})
    out = out.withColumns(
        {k: F.filter(k, lambda s: s["score"] >= MIN_SCORE) for k in patterns if k not in BASE}
    )
    return out.drop(*[f"__pii_{k}" for k in patterns])


def redact(found: DataFrame, text: str = "text", kinds: tuple[str, ...] = ("email", "phone")) -> DataFrame:
    """``found`` (of ``find``) with each confirmed span of ``kinds`` replaced by its kind in angle brackets;
    of spans that overlap the first counts."""
    body = whole(F.col(text))
    places = F.array_sort(F.transform(F.concat(*[F.col(k) for k in kinds]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(body, acc["at"] + 1, (s["start"] - acc["at"]).cast("int"))
        out = F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))
        ahead = F.struct(s["end"].cast("int").alias("at"), out.alias("out"))
        return F.when(s["start"] >= acc["at"], ahead).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(places, start, step, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size(places) > 0, clean).otherwise(F.col(text)))


def digest(found: DataFrame) -> DataFrame:
    base = F.concat(*[F.col(k) for k in BASE])
    every = F.concat(base, F.col("iban"), F.col("ssn"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size(F.filter(every, lambda s: s["score"] >= MIN_SCORE)).cast("long").alias("n_likely"),
    )
