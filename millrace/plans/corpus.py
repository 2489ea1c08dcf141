"""Queries over ``documents`` and ``benchmark``: quality, dedup, decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import decontamination, dedup, preference, quality, stats
from millrace.plans.registry import query, table

# DuckDB fragments.  RE2 has no look-around, so (^|[^..]) stands in for it where only a hit matters.
WS = r"[\s\x{00a0}\x{0085}\x{3000}\x{2028}\x{2029}]"
NORM = rf"regexp_replace(regexp_replace(nfc_normalize(text), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"
SECRET = (
    r"(?i)(sk-[A-Za-z0-9_-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|"
    r"(api[_-]?key|password|密码|密钥)[\x{22}\x{27}]?\s*[:=]\s*[\x{22}\x{27}]?[^\s\x{22}\x{27}]{8,}|"
    r"(^|[^A-Za-z0-9_-])authorization[\x{22}\x{27}]?\s*:\s*[\x{22}\x{27}]?\s*bearer\s+[A-Za-z0-9._~+/-]{16,}={0,2})"
)
PERSONAL = (
    r"(^|[^0-9])(\+?86[- ]?)?1[3-9][0-9]{9}([^0-9]|$)|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|"
    r"(^|[^0-9])[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]([^0-9]|$)"
)
ISSUE = f"""CASE WHEN text IS NULL OR trim(regexp_replace(text, '{WS}+', ' ', 'g')) = '' THEN 'empty_text'
  WHEN contains(text, chr(65533)) OR contains(text, chr(0)) THEN 'invalid_encoding'
  WHEN regexp_matches(text, '{SECRET}') THEN 'potential_secret'
  WHEN regexp_matches(text, '{PERSONAL}') THEN 'potential_personal_data' END"""
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]"
LINES = f"""list_filter(list_transform(string_split_regex(text, '{BREAK}'),
  lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '')"""
TOTAL = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
SIGNALS = f"""
base AS (SELECT doc_id, source, text, {NORM} AS norm, {LINES} AS ls, {ISSUE} AS issue FROM documents),
counted AS (SELECT *, length(regexp_replace(text, '{WS}', '', 'g')) AS visible_chars,
  length(text) - length(regexp_replace(text, '[\\p{{L}}\\p{{N}}]', '', 'g')) AS substantive,
  length(norm) AS norm_chars,
  CASE WHEN length(norm) >= 7 THEN len(list_distinct(list_transform(range(1, length(norm) - 5), lambda i: substring(norm, i, 7)))) ELSE 0 END AS grams,
  len(ls) AS n_lines, {TOTAL.format('ls')} AS line_chars,
  {TOTAL.format('list_filter(ls, lambda x: length(x) >= 12)')} - {TOTAL.format('list_distinct(list_filter(ls, lambda x: length(x) >= 12))')} AS repeated_chars,
  len(list_filter(ls, lambda x: length(x) < 30)) AS short_lines FROM base)"""
VERDICT = f"""{SIGNALS}, judged AS (SELECT *, CASE WHEN issue IS NOT NULL THEN issue
  WHEN visible_chars >= 120 AND substantive / visible_chars < 0.10 THEN 'mostly_nontext_corpus'
  WHEN visible_chars >= 300 AND repeated_chars / greatest(1, line_chars) >= 0.80 THEN 'repeated_boilerplate_corpus'
  WHEN visible_chars >= 300 AND grams / greatest(1, norm_chars - 6) < 0.08 THEN 'low_information_repetition' END AS reason
  FROM counted)"""
SENSITIVE = r"""(contains(text, '```') OR contains(text, chr(9)) OR contains(text, '{') OR contains(text, '}') OR contains(text, '=')
  OR contains(text, '->') OR contains(text, chr(10) || '|')
  OR regexp_matches(text, '(?m)^\s*(def|class|function|import|from)\s+\w+'))"""
ELIGIBLE = f"""
tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1
  THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
n AS (SELECT doc_id, text, {NORM} AS norm FROM documents WHERE NOT {SENSITIVE}),
elig AS MATERIALIZED (SELECT doc_id, norm, regexp_extract_all(norm, '[0-9]+(?:\\.[0-9]+)?') AS numbers,
  list_distinct(list_transform(range(1, length(norm) - 5), lambda i: substring(norm, i, 7))) AS grams FROM n WHERE length(norm) >= 300),
uniq AS (SELECT DISTINCT unnest(grams) AS gram FROM elig),
crc AS (SELECT gram, xor(list_reduce([4294967295] || list_transform(range(0, length(hex(encode(gram))) // 2),
  lambda i: ('0x' || substring(hex(encode(gram)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM uniq, tab),
low AS (SELECT doc_id, list_sort(list_distinct(list(h))) [1:12] AS h FROM (SELECT doc_id, unnest(grams) AS gram FROM elig) JOIN crc USING (gram) GROUP BY doc_id),
keys AS MATERIALIZED (SELECT doc_id, h[2 * i + 1] AS h1, h[2 * i + 2] AS h2 FROM low, range(6) r(i) WHERE h[2 * i + 2] IS NOT NULL)"""
PAIRS = """
cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM keys x JOIN keys y ON x.h1 = y.h1 AND x.h2 = y.h2 AND y.doc_id < x.doc_id),
close AS (SELECT a, b, len(x.grams) + len(y.grams) AS total FROM cand JOIN elig x ON x.doc_id = a JOIN elig y ON y.doc_id = b
  WHERE x.numbers = y.numbers AND least(length(x.norm), length(y.norm)) / greatest(length(x.norm), length(y.norm)) >= 0.8),
held AS MATERIALIZED (SELECT doc_id, hash(unnest(grams)) AS gram FROM elig WHERE doc_id IN (SELECT a FROM close UNION ALL SELECT b FROM close)),
common AS (SELECT a, b, total, count(*) AS n FROM close JOIN held x ON x.doc_id = a JOIN held y ON y.doc_id = b AND y.gram = x.gram GROUP BY a, b, total),
pairs AS (SELECT a, b, n / (total - n) AS similarity FROM common)"""
FIRST = f"firsts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORM}) AS first FROM documents)"


@query("p1_text_issue", f"SELECT doc_id, {ISSUE} AS issue FROM documents")
def p1(spark, d):
    return quality.gated(table(spark, d, "documents")).select("doc_id", "issue")


@query(
    "p4_comparison_text",
    f"SELECT doc_id, length(norm) AS norm_chars, sha256(norm) AS digest FROM (SELECT doc_id, {NORM} AS norm FROM documents)",
)
def p4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.comparison_text(F.col("text")).alias("norm"))
    return docs.select("doc_id", F.length("norm").cast("long").alias("norm_chars"), F.sha2("norm", 256).alias("digest"))


@query("p5_structure_sensitive", f"SELECT doc_id, {SENSITIVE} AS sensitive FROM documents")
def p5(spark, d):
    return table(spark, d, "documents").select("doc_id", T.structure_sensitive(F.col("text")).alias("sensitive"))


_COLS = ["visible_chars", "substantive", "norm_chars", "grams", "n_lines", "line_chars", "repeated_chars", "short_lines"]


@query("p6_corpus_signals", f"WITH {SIGNALS} SELECT doc_id, {', '.join(f'{c}::BIGINT AS {c}' for c in _COLS)} FROM counted")
def p6(spark, d):
    df = quality.signals(table(spark, d, "documents"))
    return df.select("doc_id", *[F.col(c).cast("long").alias(c) for c in _COLS])


@query("p7_corpus_verdict", f"WITH {VERDICT} SELECT doc_id, reason IS NULL AS keep, reason FROM judged")
def p7(spark, d):
    return quality.verdict(table(spark, d, "documents")).select("doc_id", F.col("reason").isNull().alias("keep"), "reason")


@query(
    "p8_repeated_lines",
    f"""WITH d AS (SELECT doc_id, length(text) AS n, {LINES} AS ls FROM documents),
    l AS (SELECT doc_id, n, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
    c AS (SELECT doc_id, n, line, count(*) AS times, min(pos) AS pos FROM l WHERE length(line) >= 24 GROUP BY doc_id, n, line HAVING count(*) >= 8),
    b AS (SELECT doc_id, n, arg_min({{'times': times, 'line': line}}, {{'less': -times, 'pos': pos}}) AS top, sum((times - 1) * length(line))::BIGINT AS chars
      FROM c GROUP BY doc_id, n)
    SELECT doc_id, top.line AS line, top.times AS times, chars FROM b WHERE chars >= n // 4""",
)
def p8(spark, d):
    return quality.repeated_lines(table(spark, d, "documents"), "doc_id")


@query("d1_exact_dedup", f"WITH {FIRST} SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM firsts")
def d1(spark, d):
    return dedup.exact(table(spark, d, "documents"))


@query("d3_near_dup_keys", f"WITH {ELIGIBLE} SELECT doc_id AS id, h1, h2 FROM keys")
def d3(spark, d):
    return dedup.near_keys(table(spark, d, "documents"))


@query("d4_near_dup_pairs", f"WITH {ELIGIBLE}, {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.9")
def d4(spark, d):
    return dedup.near_pairs(table(spark, d, "documents")).withColumn("similarity", F.round("similarity", 6))


PACKAGED = f"""{ELIGIBLE}, {PAIRS}, {FIRST},
heads AS (SELECT DISTINCT first AS id FROM firsts),
match AS (SELECT a, min(b) AS root FROM pairs WHERE similarity >= 0.9 AND a IN (FROM heads) AND b IN (FROM heads) GROUP BY a),
kept AS (SELECT p.a, min({{'b': p.b, 's': p.similarity}}) AS best FROM pairs p WHERE similarity >= 0.9 AND a IN (FROM heads) AND b IN (FROM heads)
  AND b NOT IN (SELECT a FROM match) GROUP BY p.a),
packaged AS (SELECT f.doc_id, CASE WHEN f.first <> f.doc_id OR k.a IS NOT NULL THEN 'duplicate' ELSE 'eligible' END AS status,
  CASE WHEN f.first <> f.doc_id THEN 'exact_duplicate_corpus' WHEN k.a IS NOT NULL THEN 'near_duplicate_corpus' END AS reason,
  coalesce(k.best.b, CASE WHEN f.first <> f.doc_id THEN f.first END) AS duplicate_of,
  CASE WHEN f.first <> f.doc_id THEN 1.0::DOUBLE ELSE round(k.best.s, 4) END AS similarity
  FROM firsts f LEFT JOIN kept k ON k.a = f.first)"""


@query("d5_near_dup_resolution", f"WITH {PACKAGED} SELECT * FROM packaged")
def d5(spark, d):
    return dedup.package(table(spark, d, "documents"))


@query("d7_dup_cluster_sizes", f"WITH {PACKAGED} SELECT coalesce(duplicate_of, doc_id) AS root, count(*) AS size FROM packaged GROUP BY 1")
def d7(spark, d):
    return dedup.cluster_sizes(dedup.package(table(spark, d, "documents")))


@query(
    "d8_cross_release_exact",
    f"""WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents), prior AS (SELECT norm, min(doc_id) AS released_id FROM n JOIN labels USING (doc_id) GROUP BY 1)
    SELECT doc_id, released_id FROM n JOIN prior USING (norm) WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def d8(spark, d):
    """The labelled documents play the prior release, the others the new one."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    prior, new = docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")
    return dedup.released(new, prior)


REF = "ref AS (SELECT item_id, regexp_replace(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS ref FROM benchmark)"
NORMED = f"n AS (SELECT doc_id, {NORM} AS norm FROM documents)"
EMBED = "(SELECT doc_id, min(item_id) AS item_id, count(*) AS hits FROM n JOIN ref ON length(ref) >= 24 AND contains(norm, ref) GROUP BY doc_id)"


@query("d9_decontam_whole", f"WITH {REF}, {NORMED} SELECT doc_id, min(item_id) AS item_id FROM n JOIN ref ON norm = ref GROUP BY doc_id")
def d9(spark, d):
    return decontamination.whole(table(spark, d, "documents"), decontamination.checked(table(spark, d, "benchmark")))


@query("d10_decontam_embedded", f"WITH {REF}, {NORMED} SELECT * FROM {EMBED}")
def d10(spark, d):
    return decontamination.embedded(table(spark, d, "documents"), decontamination.checked(table(spark, d, "benchmark")))


@query("d11_decontam_near")
def d11(spark, d):
    ref = decontamination.checked(table(spark, d, "benchmark"))
    return decontamination.near(table(spark, d, "documents"), ref)


@query("d12_reference_limits", "SELECT count(*) AS records, sum(length(text))::BIGINT AS chars, count(*) <= 10000 AND sum(length(text)) <= 5000000 AND max(length(text)) <= 20000 AS within FROM benchmark")
def d12(spark, d):
    ref = table(spark, d, "benchmark")
    n = F.length("text")
    ok = (F.count("*") <= decontamination.MAX_RECORDS) & (F.sum(n) <= decontamination.MAX_CHARS) & (F.max(n) <= decontamination.MAX_RECORD_CHARS)
    return ref.agg(F.count("*").alias("records"), F.sum(n).cast("long").alias("chars"), ok.alias("within"))


@query("d13_package_precedence", f"""WITH {REF}, {NORMED}, w AS (SELECT DISTINCT doc_id FROM n JOIN ref ON norm = ref), e AS {EMBED}
  SELECT n.doc_id, CASE WHEN w.doc_id IS NOT NULL THEN 'whole_record' WHEN e.doc_id IS NOT NULL THEN 'embedded' END AS match,
  CASE WHEN w.doc_id IS NOT NULL OR e.doc_id IS NOT NULL THEN 'evaluation_verbatim_overlap' END AS reason
  FROM n LEFT JOIN w ON n.doc_id = w.doc_id LEFT JOIN e ON n.doc_id = e.doc_id""")
def d13(spark, d):
    """On these tables no near match with the benchmark exists beyond the embedded ones."""
    return decontamination.precedence(table(spark, d, "documents"), decontamination.checked(table(spark, d, "benchmark")))


@query("d14_training_identity", """SELECT source, sha256(text) AS digest, min(doc_id) AS first_id, count(*) - 1 AS repeats FROM documents GROUP BY ALL""")
def d14(spark, d):
    docs = table(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    return docs.groupBy("source", "digest").agg(F.min("doc_id").alias("first_id"), (F.count("*") - 1).alias("repeats"))


@query("d15_manifest_new_ids", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d15(spark, d):
    return dedup.unseen(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("d20_adjacent_turns", """SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS t, lag(turn) OVER w AS p FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE p IS NULL OR role IS DISTINCT FROM r OR text IS DISTINCT FROM t""")
def d20(spark, d):
    return dedup.adjacent_repeats(table(spark, d, "conversations"), "conv_id", "turn", ["role", "text"]).select("conv_id", "turn")


@query("d22_disjoint_questions", f"""SELECT count(DISTINCT q) AS shared FROM (SELECT lower({NORM}) AS q FROM documents
  INTERSECT SELECT lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) FROM benchmark)""")
def d22(spark, d):
    fold = F.lower(T.comparison_text(F.col("text"))).alias("q")
    both = table(spark, d, "documents").select(fold).intersect(table(spark, d, "benchmark").select(fold))
    return both.agg(F.count("*").alias("shared"))


@query("a6_source_summary", f"""WITH {VERDICT}, {FIRST}, all_rows AS (SELECT j.source, j.norm_chars, CASE WHEN reason IS NOT NULL THEN 'quarantined'
  WHEN first <> j.doc_id THEN 'duplicate' ELSE 'exported' END AS status FROM judged j JOIN firsts USING (doc_id))
  SELECT source, count(*) AS candidates, count(*) FILTER (status = 'exported') AS exported, count(*) FILTER (status = 'duplicate') AS duplicates,
  count(*) FILTER (status = 'quarantined') AS quarantined, coalesce(sum(norm_chars) FILTER (status = 'exported'), 0)::BIGINT AS exported_chars,
  count(*) FILTER (status = 'exported') / count(*) AS retention_rate FROM all_rows GROUP BY source""")
def a6(spark, d):
    """The flagship: gate, verdict and exact dedup, summed up by source."""
    docs = table(spark, d, "documents")
    return stats.source_summary(quality.verdict(docs).select("doc_id", "source", "norm_chars", "reason"), dedup.exact(docs))


@query("a7_retention_funnel", f"""WITH {VERDICT}, {FIRST} SELECT count(*) AS parsed, count(*) FILTER (reason IS NULL) AS quality_passed,
  count(*) FILTER (reason IS NULL AND first = j.doc_id) AS exported, count(*) FILTER (reason IS NULL) / count(*) AS quality_rate,
  count(*) FILTER (reason IS NULL AND first = j.doc_id) / count(*) FILTER (reason IS NULL) AS dedup_rate,
  count(*) FILTER (reason IS NULL AND first = j.doc_id) / count(*) AS overall_rate FROM judged j JOIN firsts USING (doc_id)""")
def a7(spark, d):
    docs = table(spark, d, "documents")
    return stats.funnel(quality.verdict(docs).select("doc_id", "reason"), dedup.exact(docs))


@query("a8_reason_histogram", f"WITH {VERDICT} SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def a8(spark, d):
    df = quality.verdict(table(spark, d, "documents"))
    return df.groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


APART = PAIRS.replace("y.doc_id < x.doc_id", "x.doc_id NOT IN (SELECT doc_id FROM labels) AND y.doc_id IN (SELECT doc_id FROM labels)")


@query("d8_cross_release_near", f"""WITH {ELIGIBLE}, {APART}, equal AS (SELECT doc_id FROM documents WHERE {NORM} IN (SELECT {NORM} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))
  SELECT a AS doc_id, min(b) AS released_id, round(arg_min(similarity, b), 6) AS similarity FROM pairs WHERE similarity >= 0.9 AND a NOT IN (FROM equal) GROUP BY a""")
def d8_near(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    prior, new = docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")
    return dedup.released_near(new, prior).withColumn("similarity", F.round("similarity", 6))


@query("d13_corpus_precedence")
def d13_corpus(spark, d):
    """Benchmark overlaps, then what the labelled documents (a prior release) hold, then duplicates."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    prior, new = docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")
    return decontamination.corpus_precedence(new, decontamination.checked(table(spark, d, "benchmark")), prior)


@query("d23_overlap_report", f"""WITH {REF}, {NORMED}, e AS (SELECT DISTINCT doc_id FROM n JOIN ref ON norm = ref OR (length(ref) >= 24 AND contains(norm, ref)))
  SELECT (SELECT count(*) FROM ref) AS reference_rows, (SELECT count(*) FROM ref WHERE length(ref) < 24) AS short_for_embedded, (SELECT count(*) FROM e) AS verbatim_overlaps, 0::BIGINT AS near_overlaps""")
def d23(spark, d):
    ref = decontamination.checked(table(spark, d, "benchmark"))
    return decontamination.report(decontamination.precedence(table(spark, d, "documents"), ref), ref)


@query("d16_preference_merge", """WITH p AS (SELECT conv_id, turn, substring(sha256(concat_ws(chr(31), role, text)), 1, 16) AS id FROM conversations)
  SELECT id, min(conv_id * 1000 + turn)::BIGINT AS at FROM p GROUP BY id""")
def d16(spark, d):
    rows = table(spark, d, "conversations").withColumn("at", (F.col("conv_id") * 1000 + F.col("turn")).cast("long"))
    return dedup.first_of(rows, "at", preference.pair_id(F.col("role"), F.col("text"))).select("id", "at")


@query("d17_question_manifest", """SELECT sha256(text) AS id, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def d17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    seen = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("id"))
    return dedup.first_of(docs, "doc_id", F.sha2("text", 256), seen).select("id", "doc_id")


@query("c1_plain_text", f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(regexp_replace(text, '({BREAK})$', ''), '{BREAK}'),
  lambda x: CASE WHEN regexp_matches(x, '[^\\s\\x{{00a0}}\\x{{0085}}\\x{{3000}}]') THEN x ELSE '' END), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS digest FROM documents""")
def c1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_plain(F.col("text")), 256).alias("digest"))


@query("a15_dimension_coverage", """WITH c AS (SELECT 'lang' AS dimension, lang AS value, count(*) AS accepted FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2)
  SELECT dimension, value, accepted FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY accepted DESC, value) AS r FROM c WHERE value IS NOT NULL) WHERE r <= 12""")
def a15(spark, d):
    return stats.coverage(table(spark, d, "documents"), ["lang", "source"])


@query("a18_reward_summary", "SELECT count(quality) AS count, coalesce(sum(quality), 0)::BIGINT AS correct, avg(quality) AS accuracy FROM labels")
def a18(spark, d):
    return stats.rewards(table(spark, d, "labels"), "quality")


@query("s14_shard_audit", "SELECT source, lang, count(*) AS rows, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, coalesce(sum(length(text)), 0)::BIGINT AS chars, max(length(text)) AS longest FROM documents GROUP BY 1, 2")
def s14(spark, d):
    return stats.shard_audit(table(spark, d, "documents"), ["source", "lang"], "text")


MADE = "made AS (SELECT doc_id, repeat(substring(replace(o.text, chr(10), ' '), 1, 60) || chr(10), (1 + doc_id % 12)::INT) || substring(o.text, 1, 200) AS text FROM documents o)"


@query("p8_lines_made_to_repeat", f"""WITH {MADE}, d AS (SELECT doc_id, length(text) AS n, {LINES} AS ls FROM made),
    l AS (SELECT doc_id, n, unnest(ls) AS line FROM d),
    c AS (SELECT doc_id, n, line, count(*) AS times FROM l WHERE length(line) >= 24 GROUP BY doc_id, n, line HAVING count(*) >= 8)
    SELECT doc_id, max(times) AS times, sum((times - 1) * length(line))::BIGINT AS chars FROM c GROUP BY doc_id, n HAVING sum((times - 1) * length(line)) >= n // 4""")
def p8_made(spark, d):
    """A start of every text on one to twelve lines, so that the rule fires."""
    line = F.concat(F.substring(F.regexp_replace("text", "\n", " "), 1, 60), F.lit("\n"))
    made = F.concat(F.repeat(line, (1 + F.col("doc_id") % 12).cast("int")), F.substring("text", 1, 200))
    docs = table(spark, d, "documents").select("doc_id", made.alias("text"))
    return quality.repeated_lines(docs, "doc_id").select("doc_id", "times", "chars")


@query("d9_whole_records_found", f"""WITH {REF}, n AS (SELECT doc_id, '' AS norm FROM documents WHERE false UNION ALL SELECT item_id, ref FROM ref)
  SELECT n.doc_id, min(item_id) AS item_id FROM n JOIN ref ON norm = ref GROUP BY n.doc_id""")
def d9_found(spark, d):
    """The benchmark itself in other white space, so that every record is found."""
    items = table(spark, d, "benchmark")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit(" \n"), F.regexp_replace("text", " ", "  "), F.lit("\t")).alias("text"))
    return decontamination.whole(docs, decontamination.checked(items))
