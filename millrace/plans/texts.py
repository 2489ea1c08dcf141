"""Queries over control phrases, LaTeX chunks and review units."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import latex, marking, review_units
from millrace.plans.registry import query, table

# --- control phrases ---------------------------------------------------------------------------

RULES = [marking.Rule("article", ("der", "de la", "the"), "[[ARTICLE]]"), marking.Rule("link", ("and", "of"), "[[LINK]]", "(link)")]
PREFIX = 128
#: The query's texts begin, by turn: as they are; with a pair around an unknown phrase; with a closing tag;
#: with an opening tag alone; with a pair around a known phrase.
OPEN, CLOSE = "<reason-strength>", "</reason-strength>"
BEGINS = ("", f"{OPEN}x{CLOSE} ", f"{CLOSE} ", f"{OPEN} ", f"{OPEN}of{CLOSE} ")

# A word may be cut off by the end of the prefix: it counts only if it ends there, so the SQL looks one character on.
_PUT = "CASE WHEN regexp_matches(w, '^(and|of)$') THEN {link} ELSE '<reason-strength>' || w || '</reason-strength>' END"
_WORDS = r"(de la|and|der|the|of)"
E9_SQL = rf"""WITH c AS (SELECT conv_id, turn, text, (turn % 5)::INT AS kind, CASE (turn % 5) WHEN 1 THEN {PREFIX - len(BEGINS[1]) + 1} WHEN 4 THEN {PREFIX - 2} ELSE {PREFIX} END AS left_over,
    CASE WHEN turn % 5 IN (1, 4) THEN ' ' || text ELSE text END AS body FROM conversations),
  k AS (SELECT *, CASE WHEN regexp_matches(left(body, left_over + 1), '(^|[^\p{{L}}\p{{N}}_]){_WORDS}[\p{{L}}\p{{N}}_]$')
      THEN left_over - length(regexp_extract(left(body, left_over), '{_WORDS}$')) ELSE left_over END AS cut FROM c),
  w AS (SELECT *, regexp_replace(left(body, cut), '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g') AS marked FROM k),
  r AS (SELECT *, regexp_replace(replace(marked, chr(1) || 'de' || chr(2) || ' ' || chr(1) || 'la' || chr(2), chr(1) || 'de la' || chr(2)),
      chr(1) || '(de la|der|the)' || chr(2), '{OPEN}\1{CLOSE}', 'g') AS articles FROM w),
  s AS (SELECT *, replace(replace(articles, chr(1) || 'and' || chr(2), '(link)'), chr(1) || 'of' || chr(2), '(link)') AS put FROM r)
SELECT conv_id, turn, CASE kind WHEN 2 THEN '{BEGINS[2]}' || text WHEN 3 THEN '{BEGINS[3]}' || text
    WHEN 1 THEN '{BEGINS[1][:-1]}' || translate(put, chr(1) || chr(2), '') || substr(body, cut + 1)
    WHEN 4 THEN '(link)' || translate(put, chr(1) || chr(2), '') || substr(body, cut + 1)
    ELSE translate(put, chr(1) || chr(2), '') || substr(body, cut + 1) END AS text,
  CASE WHEN kind IN (2, 3) THEN 0 ELSE (length(put) - length(replace(put, '(link)', ''))) // 6 + (kind = 4)::INT END AS replacements,
  CASE WHEN kind IN (2, 3) THEN 'control_text_unbalanced_tags' END AS issue
FROM s"""


@query("e9_control_text", E9_SQL)
def e9(spark, d):
    begin = F.element_at(F.array(*map(F.lit, BEGINS)), F.pmod("turn", F.lit(5)).cast("int") + 1)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(begin, "text").alias("text"))
    found = marking.mark(rows, marking.Marker(RULES, prefix=PREFIX), replace=True)
    return found.select("conv_id", "turn", "marked.text", "marked.replacements", "marked.issue")


# --- LaTeX -------------------------------------------------------------------------------------

#: What each text is wrapped in, by id: a nested environment after it, a formula before it, a literal block
#: around it, or an environment that never ends.
PARTS = {
    0: ("", "\n\n\\begin{align}\\begin{cases} a & b \\\\ c & d \\end{cases}" + " + x" * 200 + "\\end{align}\n"),
    1: ("$$" + "y = z " * 150 + "$$ and $a$ \\emph{so on} ", ""),
    2: ("\\begin{verbatim}\n", "\n\\end{verbatim}"),
    3: ("\\begin{table} ", ""),
}


@query(
    "c4_latex_chunks",
    r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 """
    + " ".join(f"WHEN {k} THEN '{a}' || text || '{b}'" for k, (a, b) in PARTS.items())
    + r""" END AS text FROM (SELECT doc_id, translate(text, '\$%{}[]', '') AS text FROM documents)),
    n AS (SELECT doc_id, length(regexp_replace(text, '[\s\x0B]+', '', 'g')) AS chars, length(text) - length(replace(text, '$$', '$')) AS doubles FROM d)
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'latex_unclosed_environment' END AS issue, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE chars END AS chars,
    0::BIGINT AS broken, doc_id % 4 = 2 AS in_one FROM n""",
)
def c4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.translate("text", "\\$%{}[]", "").alias("text"))
    at = F.pmod("doc_id", F.lit(4)).cast("int") + 1
    before, after = (F.element_at(F.array(*(F.lit(PARTS[k][i]) for k in range(4))), at) for i in (0, 1))
    made = docs.select("doc_id", F.concat(before, "text", after).alias("text"))
    chunk = latex.chunked(made)
    times = lambda x: F.coalesce((F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))) / len(x), F.lit(0))
    cut = (times("\\begin{") != times("\\end{")) | (times("$") % 2 != 0)
    visible = F.length(F.regexp_replace("text", r"[\s\x0B]+", ""))
    return chunk.groupBy("doc_id").agg(
        F.max("issue").alias("issue"), F.coalesce(F.sum(visible), F.lit(0)).alias("chars"), F.count(F.when(cut, 1)).alias("broken"),
        F.bool_or(F.coalesce(F.col("text").startswith("\\begin{verbatim}") & F.col("text").endswith("\\end{verbatim}"), F.lit(False))).alias("in_one"),
    )


# --- review units ------------------------------------------------------------------------------

BLOCK = "\n```\nkept whole. every one! of these?\n\nok.\n```"


@query(
    "c12_review_units",
    rf"""WITH p AS (SELECT conv_id, turn, text, unnest(regexp_split_to_array(
      regexp_replace(regexp_replace(regexp_replace(text, '(^|\n)([ \t]*(?:[A-Za-z]|\d+))\.([ \t]+\S)', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), '(?i)(^|[^\p{{L}}\p{{N}}_])(mr|mrs|ms|dr|prof|sr|jr|st|vs|etc)\.', '\1\2' || chr(2), 'g'), '(?i),([ \t\r\n]+(and|but|so|therefore|whereas)([^\p{{L}}\p{{N}}_]|$))', chr(1) || '\1', 'g'), '[.!?](\s|$)|\x01')) AS part FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1 ELSE count(*) FILTER (trim(part, E' \n') <> '') END AS units, length(regexp_replace(text, '\s', '', 'g')) + (turn % 3 = 1)::INT * {len(''.join(BLOCK.split()))} AS chars,
    0::BIGINT AS wrong FROM p GROUP BY conv_id, turn, text""",
)
def c12(spark, d):
    """Turns as fields: every third is no prose (one unit), every third has a fenced block after it, whose
    sentences stay together; fine units of the rest end at sentences."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    kind = F.pmod("turn", F.lit(3))
    fields = turns.select(
        "conv_id", "turn", F.lit(0).alias("at"), F.when(kind == 0, "tool_calls").otherwise("content").alias("field"),
        F.when(kind == 1, F.concat("text", F.lit(BLOCK))).otherwise(F.col("text")).alias("text"), F.col("text").alias("own"),
    )
    units = review_units.units(fields, ["conv_id"], "turn", "at", fine=True).withColumnRenamed("text", "unit")
    whole = fields.select("conv_id", "turn", "text").join(units, ["conv_id", "turn"])
    same = F.expr("substring(text, int(start) + 1, int(end - start))") == F.col("unit")
    fenced = F.col("unit").contains("```")
    return whole.groupBy("conv_id", "turn").agg(
        (F.count("*") - F.count(F.when(fenced & F.col("unit").startswith("```"), 1))).alias("units"),
        F.sum(F.length(F.regexp_replace("unit", r"\s", ""))).alias("chars"), F.count(F.when(~same, 1)).alias("wrong"),
    )
