"""Queries over claims, evidence, issues and supervision."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import conversations, evidence, search
from millrace.plans import workflow  # noqa: F401  (registers k2)
from millrace.plans.corpus import ISSUE
from millrace.plans.registry import ORACLES, query, table
from millrace.plans.talk import MSG


@query("c13_review_windows", """WITH RECURSIVE u AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  w AS (SELECT conv_id, turn, i, 0 AS "window", 1 AS units, n AS chars FROM u WHERE i = 1 UNION ALL
    SELECT u.conv_id, u.turn, u.i, w."window" + (w.units >= 12 OR w.chars + u.n > 600)::INT, CASE WHEN w.units >= 12 OR w.chars + u.n > 600 THEN 1 ELSE w.units + 1 END,
      CASE WHEN w.units >= 12 OR w.chars + u.n > 600 THEN u.n ELSE w.chars + u.n END FROM w JOIN u ON u.conv_id = w.conv_id AND u.i = w.i + 1)
  SELECT conv_id, turn, "window" FROM w""")
def c13(spark, d):
    """Turns play review units; windows of 600 characters, so that conversations have several."""
    return evidence.review_windows(table(spark, d, "conversations"), "conv_id", "turn", "text", chars=600)


@query("g9_half_comparison", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'unresolved' WHEN holds THEN 'verified' ELSE 'violated' END AS status,
  CASE WHEN p_partkey % 7 = 0 THEN 'assertion_stance_needs_evidence' WHEN p_partkey % 11 = 0 THEN 'source_wide_absence_not_established'
    WHEN p_partkey % 13 = 0 THEN 'comparison_reference_unresolved' WHEN NOT holds THEN 'comparison_value_conflict' END AS issue
  FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN v < 50 WHEN 1 THEN v > 50 WHEN 2 THEN v >= 50 ELSE v <= 50 END AS holds
    FROM (SELECT p_partkey, p_size + 25 + (p_partkey % 3) / 10 AS v FROM part))""")
def g9(spark, d):
    """Each part says what share it is; some say it in another's name, of a whole paper, or roughly."""
    k = F.col("p_partkey")
    phrase = F.element_at(F.array(*[F.lit(x) for x in ("less than half", "more than half", "at least half", "at most half")]), (k % 4 + 1).cast("int"))
    share = F.concat((F.col("p_size") + 25).cast("string"), F.lit("."), (k % 3).cast("string"), F.lit("%, which is "), phrase)
    quote = (
        F.when(k % 11 == 0, "The paper never gave the number.")
        .when(k % 13 == 0, F.concat(F.lit("It is about "), share))
        .otherwise(F.concat(F.lit("The share is "), share, F.lit(".")))
    )
    stance = F.when(k % 7 == 0, "quoted").otherwise("asserted")
    found = evidence.half_comparison(quote, stance, F.lit("claim"))
    return table(spark, d, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.status", "f.issue")


@query("j13_attached_evidence", """WITH r AS (SELECT sha256(d.text) AS id, arg_min('{"label":' || l.quality || '}', l.doc_id) AS evidence FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0 GROUP BY 1)
  SELECT doc_id, coalesce(evidence, '{}') AS evidence FROM documents LEFT JOIN r ON r.id = sha256(text)""")
def j13(spark, d):
    """Labels play records of the documents' texts; toxic ones are not eligible."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    said = F.concat(F.lit('{"label":'), F.col("quality").cast("string"), F.lit("}")).alias("evidence")
    status = F.when(F.col("toxic") == 0, "eligible").otherwise("quarantined").alias("status")
    records = docs.join(table(spark, d, "labels").select("doc_id", status, said), "doc_id")
    return evidence.with_evidence(docs.withColumn("id", F.sha2("text", 256)), records, "id", F.col("text"), "doc_id", "evidence").select("doc_id", "evidence")


@query("j14_hits_with_base", f"SELECT h.query_id, h.doc_id, h.score, b.source, b.lang FROM ({ORACLES['k2_bm25_topk']}) h JOIN documents b USING (doc_id)")
def j14(spark, d):
    docs = table(spark, d, "documents")
    hits = search.bm25(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)
    return search.with_base(hits, docs, ["source", "lang"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "source", "lang")


STORE = """k AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM orders),
  s AS (SELECT o_custkey, o_orderkey, o_orderstatus, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS superseded_by FROM k WHERE was IS DISTINCT FROM o_orderstatus)"""


def _issues(spark, d):
    return evidence.issue_store(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", ["o_orderstatus"])


@query("l6_issue_store", f"WITH {STORE} SELECT o_custkey, o_orderkey, o_orderstatus, superseded_by FROM s")
def l6(spark, d):
    """Orders play issues of their customer; their status is what an issue says."""
    return _issues(spark, d)


@query("l6_next_issues", f"""WITH {STORE}, e AS (SELECT *, CASE o_orderkey % 3 WHEN 1 THEN 'needs_revision' WHEN 2 THEN 'completed' ELSE 'pending' END AS status FROM s WHERE superseded_by IS NULL)
  SELECT o_orderkey, status FROM e WHERE status <> 'completed' ORDER BY status = 'needs_revision', o_orderkey LIMIT 200""")
def l6_next(spark, d):
    """The batch of 200 is what this asks for."""
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 1, "needs_revision").otherwise("completed").alias("status")
    events = table(spark, d, "orders").filter(k % 3 != 0).select("o_orderkey", F.lit(1).alias("seq"), said)
    return evidence.next_issues(_issues(spark, d), events, "o_orderkey", "seq", "o_orderkey", 200).select("o_orderkey", "status")


@query("e11_supervision", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'training_validation_invalid_token_alignment' WHEN p_partkey % 5 = 2 OR p_size % 9 = 0 THEN 'training_validation_incomplete_supervision' END AS issue,
  CASE WHEN p_partkey % 5 NOT IN (1, 2) AND p_size % 9 > 0 THEN p_size % 9 END AS prompt_tokens, CASE WHEN p_partkey % 5 NOT IN (1, 2) AND p_size % 9 > 0 THEN p_size + 1 - p_size % 9 END AS supervised_tokens,
  CASE WHEN p_partkey % 5 NOT IN (1, 2) AND p_size % 9 > 0 THEN p_size END AS eos_position FROM part""")
def e11(spark, d):
    """Examples of p_size ids and an end marker, p_size mod 9 of them masked; some lack a label or the marker."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("int")
    end = F.when(k % 5 == 2, 7).otherwise(2)
    ids = F.concat(F.transform(F.sequence(F.lit(1), n), lambda x: x + 100), F.array(end))
    labels = F.transform(ids, lambda x, i: F.when(i < n % 9, -100).otherwise(x))
    labels = F.when(k % 5 == 1, F.slice(labels, 1, n)).otherwise(labels)
    df = table(spark, d, "part").select("p_partkey", ids.alias("ids"), labels.alias("labels"))
    found = evidence.supervision(F.col("ids"), F.col("labels"), F.col("ids"), 2)
    return df.select("p_partkey", found.alias("f")).select("p_partkey", "f.issue", "f.prompt_tokens", "f.supervised_tokens", "f.eos_position")


@query("v4_source_conversation", f"""WITH {MSG}, j AS (SELECT conv_id, to_json(list({{'content': coalesce(text, ''), 'role': role}} ORDER BY turn))::VARCHAR AS text FROM conversations GROUP BY 1)
  SELECT conv_id, CASE WHEN length(j.text) > 2000 THEN 'context_exceeds_auto_limit' WHEN ({ISSUE}) IN ('potential_secret', 'potential_personal_data') THEN ({ISSUE}) ELSE i.issue END AS issue FROM j JOIN i USING (conv_id)""")
def v4(spark, d):
    """With a limit of 2,000 characters, which some conversations exceed."""
    return conversations.source_issues(table(spark, d, "conversations"), 2000)


@query("e12_preview", """SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN '【回答】' || text WHEN role = 'tool' THEN '【工具结果✔】' || text ELSE '【' || role || '】' || text END, chr(10) || chr(10) ORDER BY turn)
  FILTER (role <> 'assistant' OR text <> ''), '')) AS digest FROM conversations GROUP BY 1""")
def e12(spark, d):
    return conversations.preview(table(spark, d, "conversations")).select("conv_id", F.sha2("preview", 256).alias("digest"))
