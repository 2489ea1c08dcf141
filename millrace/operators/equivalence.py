"""Whether two answers are the same number, by exact fractions; never by floating point.

A decimal, a percentage, or a fraction of decimals (a/b or \\frac) is a pair of
whole numbers.  Two answers are equal where the cross products are.  Anything
that is no bare number stays unresolved, with the reason; so do numbers of more
digits than exact products hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signs and commands that a bare numeric expression may have.
SURFACE = r"^[0-9\s.{}()\[\]+*/^=%\\-]+$"
COMMANDS = r"\\(?:frac|dfrac|tfrac|sqrt|pi|left|right|cdot|times)(?![A-Za-z])"

NUMBER = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
DECIMAL = rf"^([+-]?)\s*{NUMBER}\s*(\\?%)?$"
SLASHED = rf"^([+-]?)\s*\(?{NUMBER}\)?\s*/\s*\(?{NUMBER}\)?$"
LATEX = rf"^([+-]?)\s*\\[dt]?frac\s*\{{\s*{NUMBER}\s*\}}\s*\{{\s*{NUMBER}\s*\}}$"
MOST_DIGITS = 18


def _bare(text: Column) -> Column:
    """Without the mathematics delimiters around the whole."""
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    double = F.regexp_extract(text, r"(?s)^\$\$(.+)\$\$$", 1)
    single = F.regexp_extract(text, r"(?s)^\$(.+)\$$", 1)
    return F.trim(F.when(double != "", double).when(single != "", single).otherwise(text))


def surface(text: Column) -> Column:
    """Whether the whole text is a numeric expression without units or words."""
    bare = _bare(text)
    rest = F.regexp_replace(bare, COMMANDS, "")
    return F.coalesce(rest.rlike(SURFACE) & ~rest.rlike(r"\\[A-Za-z]") & ~bare.contains("$") & ~bare.rlike(r"\d\s+\d"), F.lit(False))


def _digits(number: Column) -> Column:
    return F.regexp_replace(number, r"\.", "")


def _scale(number: Column) -> Column:
    return F.length(F.regexp_extract(number, r"\.([0-9]*)$", 1))


def rational(text: Column) -> Column:
    """struct<num decimal(20,0), den decimal(20,0)> of a number; null if it is none that is held exactly."""
    bare = _bare(text)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(bare, pattern, group)

    def fraction(pattern: str) -> tuple[Column, Column, Column]:
        a, b = part(pattern, 2), part(pattern, 3)
        # a/10^s over b/10^t is a followed by t zeros over b followed by s zeros.
        return part(pattern, 1), F.concat(_digits(a), F.repeat(F.lit("0"), _scale(b))), F.concat(_digits(b), F.repeat(F.lit("0"), _scale(a)))

    number, percent = part(DECIMAL, 2), part(DECIMAL, 3) != ""
    decimal = part(DECIMAL, 1), _digits(number), F.concat(F.lit("1"), F.repeat(F.lit("0"), _scale(number)), F.when(percent, "00").otherwise(""))
    kinds = [(DECIMAL, *decimal), (SLASHED, *fraction(SLASHED)), (LATEX, *fraction(LATEX))]
    out = F.lit(None).cast("struct<num:decimal(20,0),den:decimal(20,0)>")
    for pattern, sign, above, below in kinds:
        above, below = (F.regexp_replace(x, "^0+(?=.)", "") for x in (above, below))
        fits = (F.length(above) <= MOST_DIGITS) & (F.length(below) <= MOST_DIGITS) & (below != "0")
        num = F.concat(F.when((sign == "-") & (above != "0"), "-").otherwise(""), above)
        pair = F.struct(num.try_cast("decimal(20,0)").alias("num"), below.try_cast("decimal(20,0)").alias("den"))
        out = F.when(bare.rlike(pattern), F.when(fits, pair)).otherwise(out)
    return out


def compared(rows: DataFrame, expected: str, candidate: str) -> DataFrame:
    """``rows`` with status (matched, mismatched or unresolved) and its reason."""
    whole = surface(F.col(expected)) & surface(F.col(candidate))
    df = rows.withColumns({"_x": rational(F.col(expected)), "_y": rational(F.col(candidate))})
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    equal = wide("_x.num") * wide("_y.den") == wide("_y.num") * wide("_x.den")
    known = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    status = F.when(~whole | ~known, "unresolved").when(equal, "matched").otherwise("mismatched")
    reason = (
        F.when(~whole, "not_a_unitless_numeric_expression").when(~known, "expression_not_fully_resolved")
        .when(equal, "numeric_equivalence").otherwise("numeric_inequality")
    )
    return df.withColumns({"status": status, "reason": reason}).drop("_x", "_y")
