"""Queries over ``conversations``, chunking and page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import udfs
from millrace.operators import chunking, conversations, stats
from millrace.plans.corpus import BREAK, ISSUE, WS
from millrace.plans.registry import query, table



def _squash(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


CJK, HAN = r"[\x{4e00}-\x{9fff}]", r"[\x{3400}-\x{9fff}]"
COUNT = "len(regexp_extract_all({0}, '{1}'))"


@query("p12_language_share", f"""WITH c AS (SELECT doc_id, {COUNT.format('text', HAN)} AS h, {COUNT.format('text', '[A-Za-z]')} AS l FROM documents)
  SELECT doc_id, CASE WHEN h + l = 0 THEN 'other' WHEN h / (h + l) BETWEEN 0.2 AND 0.8 THEN 'mixed' WHEN h / (h + l) > 0.8 THEN 'zh' ELSE 'en' END AS language FROM c""")
def p12(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_share(F.col("text")).alias("language"))


@query("p13_detect_language", f"""SELECT doc_id, CASE WHEN coalesce({COUNT.format('text', CJK)} / nullif(length(text), 0), 0) > 0.15 THEN 'zh' ELSE 'en' END AS language,
  CASE WHEN regexp_matches(text, '{CJK}') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '{CJK}') THEN 'zh' ELSE 'en_or_other' END AS presence FROM documents""")
def p13(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.detect_language(t).alias("language"), T.presence_language(t).alias("presence"))


@query("p15_token_estimate", f"""SELECT doc_id, floor({COUNT.format('text', CJK)} + 1.3 * {COUNT.format(f"regexp_replace(text, '{CJK}', ' ', 'g')", '[^\\s]+')})::BIGINT AS tokens FROM documents""")
def p15(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


_TOKENS = f"""floor({COUNT.format('text', CJK)} + 1.3 * {COUNT.format(f"regexp_replace(text, '{CJK}', ' ', 'g')", '[^\\s]+')})::BIGINT"""


@query("p16_truncate_to_tokens", rf"""WITH t AS (SELECT doc_id, CASE WHEN {_TOKENS} <= 100 THEN text ELSE regexp_extract(text, '^\s*(\S+\s+){{0,74}}\S+') || '…[截断]' END AS text FROM documents)
  SELECT doc_id, text, {_TOKENS} AS tokens FROM t""")
def p16(spark, d):
    df = table(spark, d, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), F.lit(100)).alias("text"))
    return df.withColumn("tokens", T.estimate_tokens(F.col("text")).cast("long"))


@query("p17_truncate_fixed", "SELECT doc_id, sha256(CASE WHEN length(text) > 8000 THEN substring(text, 1, 8000) || '…[truncated]' ELSE text END) AS digest FROM documents")
def p17(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.truncated(F.col("text")), 256).alias("digest"))


@query("p9_cycle_repetition")
def p9(spark, d):
    df = table(spark, d, "documents").select("doc_id", udfs.cycle(F.col("text")).alias("c"))
    return df.filter("c.period IS NOT NULL").select("doc_id", "c.start", "c.end", "c.period", "c.repetitions")


@query("p11_output_predicates", """SELECT conv_id, turn, contains(text, 'the') AS has_the, length(text) BETWEEN 20 AND 400 AS in_length,
  NOT regexp_matches(text, '[0-9]') AS no_digit, json_valid(text) AS is_json FROM conversations""")
def p11(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", t.contains("the").alias("has_the"), F.length(t).between(20, 400).alias("in_length"),
        (~t.rlike("[0-9]")).alias("no_digit"), F.try_parse_json(t).isNotNull().alias("is_json"),
    )


@query("p26_page_text", f"""SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, {_squash("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS t FROM pages)""")
def p26(spark, d):
    df = table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("t"))
    return df.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("p26_plain_text", f"""SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, left({_squash("regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&quot;', chr(34)), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g')")}, 700) AS t FROM pages)""")
def p26_plain(spark, d):
    """With character references resolved, cut to 700 characters."""
    df = table(spark, d, "pages").select("page_id", T.plain_text(F.col("html"), 700).alias("t"))
    return df.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("p29_url_dedup", r"""SELECT url, min(page_id) AS page_id FROM pages WHERE regexp_matches(url, '^https?://[^/@\s]+(/|$|\?)') AND length(url) <= 1200 GROUP BY url""")
def p29(spark, d):
    ok = F.col("url").rlike(r"^https?://[^/@\s]+(/|$|\?)") & (F.length("url") <= 1200)
    return table(spark, d, "pages").filter(ok).groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("c2_paragraph_chunks")
def c2(spark, d):
    return chunking.structure(table(spark, d, "documents"), legacy=True)


@query("c3_structure_chunks")
def c3(spark, d):
    return chunking.structure(table(spark, d, "documents"))


@query("c3_chunks_rejoined", "SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM documents WHERE length(trim(text)) > 0")
def c3_rejoined(spark, d):
    """Chunks without overlap hold every character: joined again they are the text."""
    df = table(spark, d, "documents").select("doc_id", F.array_join(udfs.chunks(F.col("text")), "").alias("t"))
    return df.filter("t <> ''").select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("chars"))


@query("c9_index_chunks", "SELECT doc_id, sum(length(text))::BIGINT AS chars, true AS cut FROM documents WHERE length(trim(text)) > 0 GROUP BY doc_id")
def c9(spark, d):
    """Slices of chunks, checked by what they hold in all and by their length."""
    rows = chunking.index_chunks(table(spark, d, "documents"))
    return rows.groupBy("doc_id").agg(F.sum(F.length("chunk")).alias("chars"), (F.max(F.length("chunk")) <= 2000).alias("cut"))


CHUNKS = """w AS (SELECT doc_id, s // 1000 AS pos, substring(text, s + 1, 1400) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS s FROM documents))"""
ID = f"substring(sha256(regexp_replace(chunk, '{WS}+', '', 'g')), 1, 16)"


@query("c5_chunk_ids", f"WITH {CHUNKS} SELECT doc_id, pos, {ID} AS chunk_id FROM w")
def c5(spark, d):
    df = chunking.windows(table(spark, d, "documents"))
    return df.select("doc_id", (F.col("start") / 1000).cast("int").alias("pos"), T.chunk_id(F.col("passage")).alias("chunk_id"))


@query("c6_chunk_corpus", f"""WITH {CHUNKS}, i AS (SELECT *, {ID} AS chunk_id FROM w), f AS (SELECT chunk_id, min({{'d': doc_id, 'p': pos}}) AS first FROM i GROUP BY 1)
  SELECT chunk_id, doc_id, pos, length(chunk) AS chars FROM i JOIN f USING (chunk_id) WHERE first.d = doc_id AND first.p = pos""")
def c6(spark, d):
    df = chunking.windows(table(spark, d, "documents")).select("doc_id", (F.col("start") / 1000).cast("int").alias("pos"), F.col("passage").alias("chunk"))
    return chunking.corpus(df).select("chunk_id", "doc_id", "pos", F.length("chunk").alias("chars"))


@query("c7_oversized_blocks", "SELECT doc_id, length(text) > 12000 AS oversized FROM documents")
def c7(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.oversized(F.col("text")).alias("oversized"))


@query("c8_chunk_windows", "SELECT doc_id, s AS start, sha256(substring(text, s + 1, 1400)) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS s FROM documents)")
def c8(spark, d):
    return chunking.windows(table(spark, d, "documents")).select("doc_id", "start", F.sha2("passage", 256).alias("digest"))


@query("c10_line_ranges", """SELECT doc_id, 1 AS first, 2 AS last, CASE WHEN len(string_split(text, chr(10))) >= 2 THEN array_to_string(string_split(text, chr(10))[1:2], chr(10)) END AS passage
  FROM documents""")
def c10(spark, d):
    docs = table(spark, d, "documents")
    return chunking.line_ranges(docs, docs.select("doc_id", F.lit(1).alias("first"), F.lit(2).alias("last")))


@query("c11_quote_spans", """SELECT doc_id, strpos(text, 'the') - 1 AS start, strpos(text, 'the') + 2 AS "end" FROM documents WHERE contains(text, 'the')""")
def c11(spark, d):
    at = F.locate("the", F.col("text"))
    return table(spark, d, "documents").filter(at > 0).select("doc_id", (at - 1).alias("start"), (at + 2).alias("end"))


@query("c15_message_windows", """WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations)
  SELECT conv_id, (greatest(u - 1, 0) // 8)::BIGINT AS "window", min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS messages FROM n GROUP BY 1, 2""")
def c15(spark, d):
    return conversations.message_windows(table(spark, d, "conversations"))


_STRONG = r"(?i)[0-9]|(^|[^\p{L}\p{N}_])(always|never|all|none|every|only|must)($|[^\p{L}\p{N}_])"


@query("p27_claim_anchors", rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*\s*|[.!?\n]\s*') AS parts FROM documents),
  s AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM p),
  q AS (SELECT doc_id, rtrim(part, ' ') AS quote, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM s)
  SELECT doc_id, start, quote, left(sha256('text:' || start || ':' || quote), 16) AS claim_id FROM q WHERE regexp_matches(quote, '{_STRONG}')""")
def p27(spark, d):
    return chunking.claims(table(spark, d, "documents"))


MSG = f"""m AS (SELECT conv_id, turn, role, text, CASE WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'invalid_role'
  WHEN coalesce(text, '') <> '' AND ({ISSUE}) IS NOT NULL THEN ({ISSUE}) WHEN role = 'tool' THEN 'orphan_tool_result'
  WHEN trim(coalesce(text, '')) = '' THEN 'empty_message' END AS r FROM conversations),
i AS (SELECT conv_id, coalesce(arg_min(r, turn) FILTER (r IS NOT NULL), CASE WHEN NOT bool_or(role = 'user') THEN 'missing_user'
  WHEN arg_max(role, turn) <> 'assistant' OR trim(arg_max(coalesce(text, ''), turn)) = '' THEN 'missing_final_answer' END) AS issue FROM m GROUP BY conv_id)"""


@query("v1_conversation_issue", f"WITH {MSG} SELECT conv_id, issue FROM i")
def v1(spark, d):
    return conversations.issues(table(spark, d, "conversations"))


@query("v3_completed_turns", f"""WITH {MSG}, p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role <> 'system'),
  b AS (SELECT *, CASE WHEN role = 'user' AND prev = 'user' THEN 'unanswered_user_turn' WHEN role = 'assistant' AND coalesce(prev, '') <> 'user' THEN 'assistant_without_user_turn' END AS bad FROM p),
  a AS (SELECT conv_id, arg_min(bad, turn) FILTER (bad IS NOT NULL) AS bad, min(turn) FILTER (bad IS NOT NULL) AS bad_at, arg_max(role, turn) AS last,
    count(*) FILTER (role = 'assistant') AS ends, min(turn) AS start FROM b GROUP BY conv_id),
  s AS (SELECT c.conv_id, min(c.turn) AS placed FROM conversations c JOIN a USING (conv_id) WHERE role = 'system' AND c.turn > a.start GROUP BY 1),
  j AS (SELECT i.conv_id, ends, CASE WHEN issue IS NOT NULL THEN issue WHEN placed IS NOT NULL AND (bad_at IS NULL OR placed < bad_at) THEN 'system_message_out_of_place'
    WHEN bad IS NOT NULL THEN bad WHEN last <> 'assistant' THEN 'unanswered_user_turn' WHEN ends < 2 THEN 'insufficient_completed_turns' END AS issue
    FROM i LEFT JOIN a USING (conv_id) LEFT JOIN s USING (conv_id))
  SELECT conv_id, CASE WHEN issue IS NULL THEN ends ELSE 0 END AS completed, issue FROM j""")
def v3(spark, d):
    return conversations.completed_turns(table(spark, d, "conversations"))


@query("v13_classify_report", """SELECT CASE WHEN n > 2 THEN 'long' ELSE 'short' END AS tag, CASE WHEN last = 'assistant' THEN 'answer' ELSE 'open' END AS finish, count(*) AS n
  FROM (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last FROM conversations GROUP BY 1) GROUP BY 1, 2""")
def v13(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("m"), F.max_by("role", "turn").alias("last"))
    tag = F.when(F.col("m") > 2, "long").otherwise("short").alias("tag")
    finish = F.when(F.col("last") == "assistant", "answer").otherwise("open").alias("finish")
    return per.groupBy(tag, finish).agg(F.count("*").alias("n"))


@query("v14_errors_to_pairs", """SELECT user_id, event_id AS error_at, call, bad_at FROM (SELECT *, max(CASE WHEN NOT failed THEN event_id END)
  OVER (PARTITION BY user_id, call ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad_at
  FROM (SELECT *, event_type = 'error' AS failed, date_trunc('day', ts)::DATE::VARCHAR AS call FROM events)) WHERE failed AND bad_at IS NOT NULL""")
def v14(spark, d):
    """Events play the trace: an error of a user fails that day's latest other step."""
    steps = table(spark, d, "events").withColumn("call", F.to_date("ts").cast("string"))
    return conversations.dpo_from_errors(steps, "user_id", "event_id", "call", F.col("event_type") == "error")


@query("w3_numbered_turns", """SELECT conv_id, turn, sum((role = 'user')::INT) OVER w::BIGINT AS user_turn, lag(role) OVER w AS previous_role FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w3(spark, d):
    return conversations.numbered(table(spark, d, "conversations")).select("conv_id", "turn", "user_turn", "previous_role")


@query("e1_to_sharegpt", """WITH m AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system' AND text <> '') AS system,
  list({'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE 'observation' END, 'value': text} ORDER BY turn)
    FILTER (role <> 'system' AND NOT (role = 'assistant' AND text = '')) AS said, bool_or(role = 'assistant' AND text <> '') AS out FROM conversations GROUP BY conv_id)
  SELECT conv_id, system, to_json(said)::VARCHAR AS conversations FROM m WHERE out""")
def e1(spark, d):
    return conversations.to_sharegpt(table(spark, d, "conversations"))


@query("e2_to_chat", """SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant')""")
def e2(spark, d):
    return conversations.to_chat(table(spark, d, "conversations"))


@query("e10_per_turn_examples", """SELECT conv_id, turn, history, history_chars, target_chars FROM (SELECT conv_id, turn, role, length(text) AS target_chars,
  count(*) OVER w AS history, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS history_chars FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'""")
def e10(spark, d):
    return conversations.per_turn_examples(table(spark, d, "conversations"))


FEATURES = f"""f AS (SELECT conv_id, coalesce(sum(length(text)), 0)::BIGINT AS body_chars, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_chars,
  count(*) FILTER (role = 'user') AS user_turns, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS target_chars,
  sum({COUNT.format('text', HAN)}) AS h, sum({COUNT.format('text', '[A-Za-z]')}) AS l FROM conversations GROUP BY conv_id),
g AS (SELECT * EXCLUDE (h, l), CASE WHEN coalesce(h + l, 0) = 0 THEN 'other' WHEN h / (h + l) BETWEEN 0.2 AND 0.8 THEN 'mixed' WHEN h / (h + l) > 0.8 THEN 'zh' ELSE 'en' END AS language FROM f)"""


@query("a1_record_features", f"WITH {FEATURES} SELECT * FROM g")
def a1(spark, d):
    return stats.conversation_features(table(spark, d, "conversations"))


@query("a2_distribution", f"""WITH {FEATURES} SELECT language, count(*) AS rows, sum(body_chars)::BIGINT AS body_chars, sum(target_chars)::BIGINT AS target_chars,
  sum(user_turns)::BIGINT AS user_turns FROM g GROUP BY language""")
def a2(spark, d):
    df = stats.conversation_features(table(spark, d, "conversations"))
    total = lambda c: F.sum(c).cast("long").alias(c)
    return df.groupBy("language").agg(F.count("*").alias("rows"), total("body_chars"), total("target_chars"), total("user_turns"))


LENGTHS = ["0-200", "201-1000", "1001-4000", "4001-16000", "16001+"]
TURNS = ["0", "1", "2", "3-5", "6+"]


@query("a4_length_histogram", f"""WITH b AS (SELECT unnest({LENGTHS}) AS bin), c AS (SELECT CASE WHEN length(text) <= 200 THEN '0-200' WHEN length(text) <= 1000 THEN '201-1000'
  WHEN length(text) <= 4000 THEN '1001-4000' WHEN length(text) <= 16000 THEN '4001-16000' ELSE '16001+' END AS bin FROM documents)
  SELECT bin, count(c.bin) AS n FROM b LEFT JOIN c USING (bin) GROUP BY bin""")
def a4(spark, d):
    return stats.histogram(table(spark, d, "documents"), T.length_bin(F.length("text")), LENGTHS)


@query("a4_turn_histogram", f"""WITH {FEATURES}, b AS (SELECT unnest({TURNS}) AS bin), c AS (SELECT CASE WHEN user_turns <= 2 THEN user_turns::VARCHAR WHEN user_turns <= 5 THEN '3-5' ELSE '6+' END AS bin FROM f)
  SELECT bin, count(c.bin) AS n FROM b LEFT JOIN c USING (bin) GROUP BY bin""")
def a4_turns(spark, d):
    return stats.histogram(stats.conversation_features(table(spark, d, "conversations")), T.turn_bin(F.col("user_turns")), TURNS)
