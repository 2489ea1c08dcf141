"""Queries over review state, preference pairs, retrieval, arithmetic and events.

Roles are played by the given tables: ``labels`` are decisions, ``orders``
rounds and receipts, ``events`` the event log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import udfs
from millrace.operators import arithmetic, preference, review, search
from millrace.plans.registry import query, table

DECISION = "CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END"


def _responses(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("decision"))


@query("j1_response_join", f"SELECT doc_id, source, {DECISION} AS decision FROM documents JOIN labels USING (doc_id)")
def j1(spark, d):
    return table(spark, d, "documents").join(_responses(spark, d), "doc_id").select("doc_id", "source", "decision")


@query("j2_review_page", f"""SELECT doc_id, n_chars, coalesce({DECISION.replace('ELSE', "WHEN quality IS NOT NULL THEN")}, 'pending') AS decision
  FROM documents LEFT JOIN labels USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100""")
def j2(spark, d):
    rows = review.with_decision(table(spark, d, "documents"), _responses(spark, d), "doc_id")
    return review.page(rows.select("doc_id", "n_chars", "decision").orderBy(F.desc("n_chars"), "doc_id"), [F.desc("n_chars"), "doc_id"], 100, 50)


@query("j3_review_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3(spark, d):
    return review.pending(table(spark, d, "documents"), _responses(spark, d), "doc_id").select("doc_id")


@query("j4_review_reviewed", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j4(spark, d):
    return review.reviewed(table(spark, d, "documents"), _responses(spark, d), "doc_id").select("doc_id")


@query("a14_review_counts", f"""SELECT source, count(*) FILTER (quality = 1) AS keep, count(*) FILTER (quality = 0) AS reject, count(*) FILTER (quality IS NULL) AS pending
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def a14(spark, d):
    rows = review.with_decision(table(spark, d, "documents"), _responses(spark, d), "doc_id")
    of = lambda x: F.count(F.when(F.col("decision") == x, 1)).alias(x)
    return rows.groupBy("source").agg(of("keep"), of("reject"), of("pending"))


VOTES = f"votes AS (SELECT doc_id % 50 AS sample_id, {DECISION} AS decision FROM labels)"


@query("a9_review_consensus", f"""WITH {VOTES} SELECT sample_id, count(*) AS votes, CASE WHEN min(decision) = max(decision) THEN min(decision) ELSE 'conflict' END AS outcome FROM votes GROUP BY 1""")
def a9(spark, d):
    return review.consensus(_responses(spark, d).withColumn("sample_id", F.col("doc_id") % 50), "sample_id")


@query("a9_release_gate", f"""WITH {VOTES}, o AS (SELECT sample_id, CASE WHEN min(decision) = max(decision) THEN min(decision) ELSE 'conflict' END AS outcome FROM votes GROUP BY 1)
  SELECT count(*) AS reviewed, count(*) FILTER (outcome = 'keep') AS kept, count(*) FILTER (outcome = 'conflict') AS conflicts,
  round(count(*) FILTER (outcome = 'keep') / count(*), 3) AS pass_rate, count(*) >= 10 AND count(*) FILTER (outcome = 'keep') / count(*) >= 0.9 AS release FROM o""")
def a9_gate(spark, d):
    return review.gate(a9(spark, d))


@query("a10_release_report", """WITH p AS (SELECT source, sha256(text) AS digest, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, sum(length(text)) AS chars FROM documents GROUP BY 1, 2),
  i AS (SELECT source, sum(n - 1)::BIGINT AS duplicate_ids FROM (SELECT source, doc_id, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1)
  SELECT source, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_content, min(least) AS min_chars, max(most) AS max_chars, sum(chars) / sum(n) AS mean_chars, duplicate_ids
  FROM p JOIN i USING (source) GROUP BY source, duplicate_ids""")
def a10(spark, d):
    return review.release_report(table(spark, d, "documents"), "source", "doc_id", "text")


@query("j6_latest_event", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def j6(spark, d):
    return review.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("j7_symmetric_difference", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' ELSE 'right' END AS side
  FROM (SELECT DISTINCT doc_id AS id FROM labels) a FULL JOIN (SELECT DISTINCT page_id AS id FROM pages) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""")
def j7(spark, d):
    """Ids of labels against ids of pages."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return review.symmetric_difference(labels, table(spark, d, "pages").select(F.col("page_id").alias("id")), "id")


@query("j9_stale_vote_binding", f"""SELECT doc_id, sha256(text) AS digest, {DECISION} AS decision FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 0""")
def j9(spark, d):
    """Rejected toxic documents were voted on another version."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    stale = (F.col("quality") == 0) & (F.col("toxic") == 1)
    votes = table(spark, d, "labels").join(docs, "doc_id").withColumn("digest", F.when(stale, F.lit("old")).otherwise(F.col("digest")))
    votes = votes.withColumn("decision", F.when(F.col("quality") == 1, "keep").otherwise("reject")).select("doc_id", "digest", "decision")
    return review.bound(docs, votes, "doc_id", "digest")


@query("w4_low_acceptance_runs", """WITH r AS (SELECT o_orderpriority AS target, date_trunc('month', o_orderdate)::DATE AS round, count(*) FILTER (o_orderstatus = 'F') / count(*) AS rate FROM orders GROUP BY 1, 2),
  i AS (SELECT *, sum((rate >= 0.3)::INT) OVER (PARTITION BY target ORDER BY round) AS island FROM r)
  SELECT target, round, rate, sum((rate < 0.3)::INT) OVER (PARTITION BY target, island ORDER BY round)::BIGINT AS run,
  sum((rate < 0.3)::INT) OVER (PARTITION BY target, island ORDER BY round) >= 3 AS stop FROM i""")
def w4(spark, d):
    rounds = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("target"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("round")).agg(
        (F.count(F.when(F.col("o_orderstatus") == "F", 1)) / F.count("*")).alias("rate")
    )
    return review.island_stops(rounds, "target", "round", F.col("rate") < 0.3, 3)


@query("w6_queue_position", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents")
def w6(spark, d):
    return review.positions(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("w8_revision_ids", "SELECT doc_id, source || '-r' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS revision FROM documents")
def w8(spark, d):
    return review.revisions(table(spark, d, "documents").select("doc_id", "source"), F.col("source"), "doc_id").select("doc_id", "revision")


@query("t2_stable_sample", """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(source || ':' || doc_id)) AS k,
  count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= least(1000, ceil(n * 10 / 100))""")
def t2(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    return review.stable_sample(rows, "source", F.concat_ws(":", "source", F.col("doc_id").cast("string")), 10, 1000)


@query("t3_sample_escalation", """SELECT source, count(*) AS sampled, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality = 0) * 100 >= count(*) * 20 AS full_review
  FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def t3(spark, d):
    rows = table(spark, d, "documents").join(_responses(spark, d), "doc_id")
    return review.escalate(rows, "source", F.col("decision") == "reject", 20)


@query("t6_top_dimensions", """SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r <= 2""")
def t6(spark, d):
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return search.top(counts, "source", "lang", "n", 2).select("source", "lang", "n")


@query("t9_round_robin", """SELECT i AS candidate, doc_id FROM range(25000) r(i) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) d
  ON i % n = p""")
def t9(spark, d):
    """All documents are repeated in order until there are 25,000 candidates."""
    return review.round_robin(table(spark, d, "documents").select("doc_id"), "doc_id", 25_000)


@query("l8_surplus", """SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) > 40 THEN 'surplus' ELSE 'eligible' END AS status FROM documents""")
def l8(spark, d):
    rows = review.positions(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return rows.select("doc_id", "source", F.when(F.col("position") >= 40, "surplus").otherwise("eligible").alias("status"))


@query("l9_reconcile", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label-' || l.quality ELSE d.source END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def l9(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.col("source").alias("state"))
    new = table(spark, d, "labels").select("doc_id", F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("state"))
    return review.merge(old, new, "doc_id", ["state"])


@query("a20_event_inventory", """SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS invalid, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def a20(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("invalid"), F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"), F.countDistinct("user_id").alias("users"),
    )


@query("a20_event_recent", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def a20_recent(spark, d):
    return search.top(table(spark, d, "events"), "event_type", "user_id", "event_id", 5).select("event_type", "event_id")


@query("a21_production_totals", "SELECT o_orderpriority AS target, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS eligible, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def a21(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("target")).agg(
        F.count("*").alias("attempts"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("eligible"), F.sum("o_totalprice").alias("total")
    )


CANDIDATES = "c AS (SELECT source, d.doc_id, text, 3 + 2 * quality - 2 * toxic AS score FROM documents d JOIN labels l USING (doc_id))"


def _candidates(spark, d):
    score = (3 + 2 * F.col("quality") - 2 * F.col("toxic")).alias("score")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "doc_id", "text", score)


@query("q1_preference_pairs", f"""WITH {CANDIDATES}, p AS (SELECT source, arg_max({{'id': doc_id, 't': text, 's': score}}, {{'s': score, 'o': -doc_id}}) AS b,
  arg_min({{'id': doc_id, 't': text, 's': score}}, {{'s': score, 'o': doc_id}}) AS w FROM c GROUP BY source)
  SELECT source, b.id AS chosen, w.id AS rejected, b.s AS chosen_score, w.s AS rejected_score FROM p WHERE b.s >= 4 AND b.s - w.s >= 2 AND trim(b.t) <> trim(w.t)""")
def q1(spark, d):
    return preference.best_and_worst(_candidates(spark, d), "source", "text", "score", "doc_id")


@query("q2_preference_evidence", """SELECT doc_id, CASE WHEN quality <> 1 THEN 'chosen_not_accepted' WHEN 3 + 2 * quality - 2 * toxic = 3 THEN 'equal_scores' WHEN 3 + 2 * quality - 2 * toxic < 4 THEN 'chosen_score_below_minimum' END AS issue FROM labels""")
def q2(spark, d):
    score = 3 + 2 * F.col("quality") - 2 * F.col("toxic")
    return table(spark, d, "labels").select("doc_id", preference.evidence(score, F.lit(3), F.col("quality") == 1).alias("issue"))


@query("q3_pair_ids", "SELECT conv_id, turn, substring(sha256(role || chr(31) || text), 1, 16) AS pair_id, regexp_replace(text, '\\s+', '', 'g') = regexp_replace(upper(text), '\\s+', '', 'g') AS same FROM conversations")
def q3(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", preference.pair_id(F.col("role"), F.col("text")).alias("pair_id"), preference.same_answer(F.col("text"), F.upper("text")).alias("same")
    )


@query("e8_rlaif_records", f"WITH {CANDIDATES} SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS preference_rank, doc_id, score FROM c")
def e8(spark, d):
    return preference.rlaif(_candidates(spark, d), "source", "doc_id", "score")


QS = "q AS (SELECT item_id AS query_id, text FROM benchmark)"


@query("k2_bm25_topk", f"""WITH {QS}, dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
  qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM q),
  tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  sc AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2)
  SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM sc) WHERE r <= 5""")
def k2(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(table(spark, d, "documents"), q, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("k3_dice_similar", f"""WITH {QS}, dt AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents), qt AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM q)
  SELECT query_id, doc_id, 2 * len(list_intersect(dt.t, qt.t)) / (len(dt.t) + len(qt.t)) AS similarity FROM dt, qt WHERE 2 * len(list_intersect(dt.t, qt.t)) / (len(dt.t) + len(qt.t)) >= 0.4""")
def k3(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.dice(table(spark, d, "documents"), q, 0.4)


@query("k4_vector_topk", """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS similarity FROM u q, u v
  WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, round(similarity, 6) AS similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def k4(spark, d):
    """Queries are the vectors whose id is divisible by 20."""
    v = table(spark, d, "embeddings")
    found = search.nearest(v, v.filter("vec_id % 20 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("k4_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, len(embedding) AS dims FROM embeddings")
def k4_norms(spark, d):
    return search.normalised(table(spark, d, "embeddings")).select("vec_id", F.round("norm", 6).alias("norm"), F.size("embedding").cast("long").alias("dims"))


@query("k5_memory_merge", "SELECT label, list_sort(list_distinct(list(vec_id % 7))) AS sources, count(*) AS n FROM embeddings GROUP BY label")
def k5(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.sort_array(F.collect_set(F.col("vec_id") % 7)).alias("sources"), F.count("*").alias("n"))


SEED = "s AS (SELECT p_partkey AS position, (p_partkey * 65537) % (4 * 97 * 89 * 83) AS seed FROM part)"


def seeds(spark, d):
    """The keys of parts are the positions."""
    return arithmetic.seeds(table(spark, d, "part").select(F.col("p_partkey").alias("position")))


ONE = """v AS (SELECT position, seed, 2 + seed % 17 AS a, 2 + seed // 17 % 17 AS b FROM s),
  o AS (SELECT position, CASE seed % 4 WHEN 0 THEN a || ' + ' || b WHEN 1 THEN a || ' * ' || b WHEN 2 THEN (a + b) || ' - ' || b ELSE (a * b) || ' // ' || b END AS expression,
  CASE seed % 4 WHEN 0 THEN a + b WHEN 1 THEN a * b ELSE a END AS result FROM v)"""


@query("g1_arithmetic_one_step", f"""WITH {SEED}, {ONE} SELECT *, '列式：' || expression || ' = ' || result || '。因此答案是 ' || result || '。 <<' || expression || '=' || result || '>> #### ' || result AS answer FROM o""")
def g1(spark, d):
    e, r = arithmetic.one_step(F.col("seed"))
    rows = seeds(spark, d).select("position", e.alias("expression"), r.alias("result"))
    return rows.withColumn("answer", arithmetic.one_step_answer(F.col("expression"), F.col("result")))


TWO = """v AS (SELECT position, seed, 2 + seed % 97 AS a, 2 + seed // 97 % 89 AS b, 1 + seed // 8633 % 83 AS c FROM s),
  w AS (SELECT *, CASE WHEN seed % 4 = 1 THEN least(c, a * b - 1) ELSE c END AS d, (a || ' * ' || b) AS ab FROM v),
  o AS (SELECT position, seed % 4 AS family, CASE seed % 4 WHEN 2 THEN a || ' + ' || b ELSE ab END AS e1, CASE seed % 4 WHEN 2 THEN a + b ELSE a * b END AS r1,
  CASE seed % 4 WHEN 0 THEN ab || ' + ' || d WHEN 1 THEN ab || ' - ' || d WHEN 2 THEN '(' || a || ' + ' || b || ') * ' || d ELSE ab || ' + ' || d || ' * ' || b END AS e2,
  CASE seed % 4 WHEN 0 THEN a * b + d WHEN 1 THEN a * b - d WHEN 2 THEN (a + b) * d ELSE a * b + d * b END AS r2,
  CASE WHEN seed % 4 = 3 THEN '(' || ab || ' + ' || d || ' * ' || b || ') // ' || b END AS e3, CASE WHEN seed % 4 = 3 THEN (a * b + d * b) // b END AS r3 FROM w)"""


@query("g1_arithmetic_several_steps", f"""WITH {SEED}, {TWO} SELECT position, coalesce(e3, e2) AS expression, coalesce(r3, r2) AS result, concat_ws(chr(10),
  CASE family WHEN 0 THEN '先计算成组资料的总数' WHEN 1 THEN '先计算准备的资料总数' WHEN 2 THEN '先计算每天上午与下午完成的总数' ELSE '先计算原有资料总数' END || '：<<' || e1 || '=' || r1 || '>>。',
  CASE family WHEN 0 THEN '再加上额外资料' WHEN 1 THEN '再减去已经使用的资料' WHEN 2 THEN '再乘以工作的天数' ELSE '再加上新增资料' END || '：<<' || e2 || '=' || r2 || '>>。',
  '最后平均分组：<<' || e3 || '=' || r3 || '>>。', '#### ' || coalesce(r3, r2)) AS answer FROM o""")
def g1_several(spark, d):
    steps, r = arithmetic.several_steps(F.col("seed"))
    rows = seeds(spark, d).select("position", "seed", steps.alias("steps"), r.alias("result"))
    return rows.select(
        "position", F.element_at("steps", -1)["expression"].alias("expression"), "result",
        arithmetic.several_steps_answer(F.col("seed"), F.col("steps")).alias("answer"),
    )


@query("g2_evaluate_expressions", """SELECT p_partkey, CASE WHEN p_size * 3000 <= 100000 AND p_size % 7 <> 0 THEN (p_size + 3) * p_size - floor(p_size * 3000 / (p_size % 7))::BIGINT END AS value FROM part""")
def g2(spark, d):
    """Inexact division rounds down; large operands and zero divisors are invalid."""
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("("), s, F.lit("+3)*"), s, F.lit(" - "), (F.col("p_size") * 3000).cast("string"), F.lit("//"), (F.col("p_size") % 7).cast("string"))
    return table(spark, d, "part").select("p_partkey", udfs.arithmetic(text).alias("value"))


@query("g3_arithmetic_verify", f"""WITH {SEED} SELECT position, CASE WHEN position % 10 = 0 THEN 'answer_mismatch' WHEN position % 10 = 1 THEN 'other_calculation'
  WHEN position % 10 = 2 THEN 'terminal_answer_count' WHEN position % 10 = 3 THEN 'step_mismatch' END AS issue FROM s""")
def g3(spark, d):
    """Of ten answers one ends on another number, one belongs to another expression, one repeats its
    last line and one miscalculates."""
    e, r = arithmetic.one_step(F.col("seed"))
    rows = seeds(spark, d).select("position", e.alias("expression"), r.alias("result"))
    case, said = F.col("position") % 10, arithmetic.one_step_answer(F.col("expression"), F.col("result"))
    answer = (
        F.when(case == 0, F.regexp_replace(said, "#### ", "#### 9")).when(case == 2, F.concat(said, F.lit(" #### 1")))
        .when(case == 3, F.regexp_replace(said, ">>", "1>>")).otherwise(said)
    )
    expression = F.when(case == 1, F.concat(F.col("expression"), F.lit(" + 0"))).otherwise(F.col("expression"))
    rows = rows.select("position", answer.alias("answer"), expression.alias("expression"))
    return arithmetic.verified(rows, expression="expression").select("position", "issue")


@query("l3_arithmetic_ledger", f"""WITH {SEED}, {ONE}, n AS (SELECT position, CASE WHEN contains(expression, ' + ') THEN '["+",' ||
  array_to_string(list_sort(list_transform(string_split(expression, ' + '), lambda x: '["int",' || x || ']')), ',') || ']' WHEN contains(expression, ' * ') THEN '["*",' ||
  array_to_string(list_sort(list_transform(string_split(expression, ' * '), lambda x: '["int",' || x || ']')), ',') || ']' WHEN contains(expression, ' - ') THEN '["-",["int",' ||
  replace(expression, ' - ', '],["int",') || ']]' ELSE '["//",["int",' || replace(expression, ' // ', '],["int",') || ']]' END AS tree FROM o),
  f AS (SELECT position, sha256(encode('arithmetic-expression-v1') || '\\x00'::BLOB || encode(tree)) AS fingerprint FROM n)
  SELECT fingerprint, min(position) AS position FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM f WHERE position < 40) GROUP BY 1""")
def l3(spark, d):
    """New calculations: the first forty are in the ledger; operands of + and * in any order are one."""
    e, _ = arithmetic.one_step(F.col("seed"))
    rows = seeds(spark, d).select("position", e.alias("expression"))
    ledger = rows.filter("position < 40").select(arithmetic.fingerprint(F.col("expression")).alias("fingerprint"))
    return arithmetic.unseen(rows, ledger).select("fingerprint", "position")


@query("s13_repeat_template", "SELECT p_partkey AS id, 'template' AS name FROM part")
def s13(spark, d):
    """As many copies of the template as there are parts."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("template").alias("name"))


@query("s17_page_of_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def s17(spark, d):
    return review.page(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 50, 25)


@query("a17_distinct_sources", "SELECT DISTINCT source, lang FROM documents")
def a17(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("x1_union_collections", "SELECT 'corpus' AS target, doc_id AS id FROM documents UNION ALL SELECT 'evaluation', item_id FROM benchmark UNION ALL SELECT 'page', page_id FROM pages")
def x1(spark, d):
    part = lambda t, k, n: table(spark, d, t).select(F.lit(n).alias("target"), F.col(k).alias("id"))
    return part("documents", "doc_id", "corpus").unionByName(part("benchmark", "item_id", "evaluation")).unionByName(part("pages", "page_id", "page"))


@query("x2_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def x2(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query("x3_set_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def x3(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))
