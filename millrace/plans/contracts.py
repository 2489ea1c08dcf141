"""Queries over row contracts and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import contracts, ledgers
from millrace.plans.corpus import ISSUE, NORM
from millrace.plans.registry import query, table


@query("p19_corpus_row_contract", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_cpt_record' WHEN length(text) > 500000 THEN 'cpt_record_too_long' END AS issue FROM documents")
def p19(spark, d):
    return table(spark, d, "documents").select("doc_id", contracts.corpus_row(F.col("text")).alias("issue"))


VERDICT = """v AS (SELECT doc_id, quality = 1 AS keep, toxic = 0 AS grounded, true AS reasoning_valid, 2 + 3 * quality AS c, 5 - 5 * toxic AS s FROM labels)"""


def _verdicts(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    scores = F.struct(*[(5 - 5 * t).cast("int").alias(s) for s in contracts.SCORES])
    v = F.struct(
        (q == 1).alias("keep"), (t == 0).alias("grounded"), F.lit(True).alias("reasoning_valid"),
        (2 + 3 * q).cast("int").alias("correctness"), F.lit("because").alias("reason"), scores.alias("scores"),
    )
    return table(spark, d, "labels").select("doc_id", v.cast(contracts.VERDICT).alias("v"))


@query("p21_verdict_contract", f"""WITH {VERDICT} SELECT doc_id, CASE WHEN c NOT BETWEEN 1 AND 5 THEN 'invalid_judge_score' WHEN s NOT BETWEEN 1 AND 5 THEN 'invalid_jev_dimensions' END AS issue,
  keep AND grounded AND reasoning_valid AND c >= 4 AND s >= 4 AS accepted FROM v""")
def p21(spark, d):
    """Labels play verdicts: toxicity drops every dimension out of range."""
    v = F.col("v")
    return _verdicts(spark, d).select("doc_id", contracts.verdict(v).alias("issue"), contracts.accepted(v).alias("accepted"))


@query("p22_judge_suggestion", "SELECT doc_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END AS suggestion FROM labels")
def p22(spark, d):
    said = F.concat(F.lit('{"keep": '), (F.col("quality") == 1).cast("string"), F.lit(', "why": "x"}'))
    return table(spark, d, "labels").select("doc_id", contracts.judge_suggestion(said).alias("suggestion"))


@query("v6_import_counts", """SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants,
  count(*) FILTER (role = 'system') AS systems, count(*) FILTER (role = 'tool') AS tools, bool_or(role = 'user') AND arg_max(role, turn) = 'assistant' AS sft,
  bool_or(role = 'user') AND arg_max(role, turn) = 'assistant' AND count(*) FILTER (role = 'assistant') >= 2 AS multiturn,
  bool_or(role = 'user') AND arg_max(role, turn) = 'assistant' AND bool_or(role = 'tool') AS agent FROM conversations GROUP BY conv_id""")
def v6(spark, d):
    return contracts.import_counts(table(spark, d, "conversations"))


@query("v7_ordered_subset", """SELECT count(*) AS staged, 0::BIGINT AS missing, 0::BIGINT AS changed, 0::BIGINT AS out_of_order FROM labels JOIN documents USING (doc_id)""")
def v7(spark, d):
    """The labelled documents are staged from all documents, in their order."""
    source = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("pos"))
    staged = source.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return contracts.ordered_subset(staged, source, "doc_id", "digest", "pos")


@query("v20_unique_quote", """SELECT conv_id, turn, CASE WHEN n = 1 THEN strpos(text, 'the') - 1 END AS start, CASE WHEN n = 0 THEN 'quote_not_found' WHEN n > 1 THEN 'quote_not_unique' END AS issue
  FROM (SELECT *, len(string_split(text, 'the')) - 1 AS n FROM conversations)""")
def v20(spark, d):
    found = contracts.unique_quote(F.col("text"), F.lit("the"))
    return table(spark, d, "conversations").select("conv_id", "turn", found.alias("q")).select("conv_id", "turn", "q.start", "q.issue")


@query("d18_task_plan", f"""WITH t AS (SELECT doc_id, text, {NORM} AS i, ({ISSUE}) AS issue FROM documents), f AS (SELECT i, min(doc_id) AS first FROM t GROUP BY i), o AS (SELECT DISTINCT {NORM} AS i FROM benchmark)
  SELECT doc_id, CASE WHEN issue IS NOT NULL THEN issue WHEN length(text) > 512 THEN 'task_too_long' WHEN doc_id <> first OR o.i IS NOT NULL THEN 'duplicate_normalized_task' END AS issue
  FROM t JOIN f USING (i) LEFT JOIN o USING (i)""")
def d18(spark, d):
    return ledgers.planned(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text")


@query("d19_contract_identity", """SELECT conv_id, turn, sha256('["' || role || '","' || turn || '"]') AS identity FROM conversations""")
def d19(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", ledgers.identity(F.col("role"), F.col("turn")).alias("identity"))


@query("l1_vote_ledger", """WITH l AS (SELECT doc_id, 'u' || doc_id % 3 AS username, quality FROM labels), n AS (SELECT doc_id, 'u' || doc_id % 2 AS username, toxic AS quality FROM labels)
  SELECT doc_id, username, quality FROM l UNION ALL SELECT doc_id, username, quality FROM n WHERE (doc_id, username) NOT IN (SELECT (doc_id, username) FROM l)""")
def l1(spark, d):
    user = lambda k: F.concat(F.lit("u"), (F.col("doc_id") % k).cast("string")).alias("username")
    rows = table(spark, d, "labels")
    return ledgers.append(rows.select("doc_id", user(3), "quality"), rows.select("doc_id", user(2), F.col("toxic").alias("quality")), ["doc_id", "username"])


@query("j15_reviewed_release", "SELECT doc_id, 'reviewed ' || doc_id AS text FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def j15(spark, d):
    said = table(spark, d, "labels").select(
        "doc_id", F.lit(1).alias("seq"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"),
        F.concat(F.lit("reviewed "), F.col("doc_id").cast("string")).alias("text"),
    )
    return ledgers.reviewed_release(table(spark, d, "documents").select("doc_id"), said, "doc_id", "seq")[0]


@query("j16_rework_lookup", """SELECT l.doc_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'rework_candidate_missing' WHEN n > 1 THEN 'rework_candidate_ambiguous' END AS issue
  FROM labels l LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1) c ON l.doc_id = c.doc_id""")
def j16(spark, d):
    status = F.when(F.col("role") == "assistant", "eligible").otherwise("quarantined").alias("status")
    return ledgers.rework(table(spark, d, "labels"), table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), status), "doc_id")


@query("t10_production_window", "SELECT o_orderkey, CASE WHEN o_orderkey % 40 >= 30 OR o_custkey % 500 >= 400 THEN 0 ELSE least(greatest(1000 - o_custkey, 0), 200, 400 - o_custkey % 500) END AS batch FROM orders")
def t10(spark, d):
    o = table(spark, d, "orders")
    size = ledgers.batch_size(1000 - F.col("o_custkey"), F.lit(200), F.lit(400), F.col("o_custkey") % 500, F.col("o_orderkey") % 40, F.lit(30))
    return o.select("o_orderkey", size.cast("long").alias("batch"))


@query("g7_half_claim", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 * p_size < 50 WHEN 1 THEN 2 * p_size > 50 WHEN 2 THEN 2 * p_size >= 50 ELSE 2 * p_size <= 50 END AS holds FROM part""")
def g7(spark, d):
    """Each part claims that its size is a certain share of fifty."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("less than half", "more than half", "at least half", "at most half")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", contracts.half_claim(said, F.col("p_size"), F.lit(50)).alias("holds"))


@query("g8_cited_calculation", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'calculation_value_mismatch' END AS issue FROM part""")
def g8(spark, d):
    """Reported differences of sizes; every third is off by one."""
    s = lambda c: c.cast("string")
    size = F.col("p_size")
    issue = contracts.calculation_issue(
        F.lit("difference"), F.lit("10"), s(size + 10), s(size + F.when(size % 3 == 0, 1).otherwise(0)), F.lit("score"), F.lit("native"), F.lit("score_point")
    )
    return table(spark, d, "part").select("p_partkey", issue.alias("issue"))


@query("c14_context_packs", """SELECT source, doc_id, (coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000)::BIGINT AS pack FROM documents""")
def c14(spark, d):
    return ledgers.context_packs(table(spark, d, "documents"), "source", "doc_id", "n_chars", 20_000)


@query("l7_checkpoint_digests", """SELECT conv_id, sha256('{"conv_id":' || conv_id || ',"turn":' || turn || '}') AS digest FROM conversations""")
def l7(spark, d):
    return ledgers.integrity(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id")


@query("a16_source_totals", "SELECT source, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source ORDER BY source")
def a16(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars")).orderBy("source")


@query("a23_task_inventory", """SELECT o_custkey, count(*) AS runs, max(o_orderkey) AS last_run, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1""")
def a23(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("runs"), F.max("o_orderkey").alias("last_run"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status")
    )


@query("r_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def r_windows(spark, d):
    from millrace.streaming import incremental

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.event_windows(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))
