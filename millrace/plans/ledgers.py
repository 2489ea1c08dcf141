"""Queries over cached statistics, imported histories, equal answers, observed states and term samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import arithmetic, distribution, equivalence, history, history_import, ledgers, observations, packs, preference, quotes, stats
from millrace.plans.feeds import _folder
from millrace.plans.registry import query, table
from millrace.plans.workflow import ONE, SEED, seeds

# --- statistics that read only changed shards --------------------------------------------------

SHARDS = 4


def records(spark, d):
    """Training records of three targets: documents as cpt, conversations as sft, every ninth of them as
    agent_negative too."""
    docs = table(spark, d, "documents").select(F.lit("cpt").alias("target"), F.col("doc_id").alias("id"), "text", F.lit(None).cast(distribution.MESSAGES).alias("messages"))
    message = F.struct("turn", F.struct("role", F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning"), F.lit(0).alias("tool_calls"), F.lit(0).alias("images")).alias("m"))
    talks = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(message)).alias("ms"))
    talks = talks.select("id", F.lit(None).cast("string").alias("text"), F.transform("ms", lambda x: x["m"]).alias("messages"))
    sft = talks.select(F.lit("sft").alias("target"), "id", "text", "messages")
    negative = talks.filter("id % 9 = 0").select(F.lit("agent_negative").alias("target"), "id", "text", "messages")
    extra = {"reasoning": F.when(F.col("id") % 5 == 0, "因为 so"), "images": F.col("id") % 11 == 0, "tools": F.col("target") == "agent_negative"}
    return docs.unionByName(sft).unionByName(negative).withColumns(extra).withColumn("shard", F.pmod("id", F.lit(SHARDS)))


_BIN = "CASE WHEN {0} <= 200 THEN '0–200' WHEN {0} <= 1000 THEN '201–1,000' WHEN {0} <= 4000 THEN '1,001–4,000' WHEN {0} <= 16000 THEN '4,001–16,000' ELSE '16,001+' END"
_LANG = "CASE WHEN {0} + {1} = 0 THEN 'other' WHEN {0} / ({0} + {1}) BETWEEN 0.2 AND 0.8 THEN 'mixed' WHEN {0} / ({0} + {1}) > 0.8 THEN 'zh' ELSE 'en' END"
_HAN, _LATIN = (f"length(regexp_replace({{0}}, '[^{p}]', '', 'g'))" for p in ("㐀-鿿", "A-Za-z"))
A5_SQL = f"""WITH said AS (SELECT conv_id, role, text FROM conversations WHERE role IN ('user', 'assistant')),
  talks AS (SELECT conv_id AS id, coalesce(sum(length(s.text)), 0) AS body, coalesce(sum({_HAN.format("s.text")}), 0) AS han, coalesce(sum({_LATIN.format("s.text")}), 0) AS latin,
    count(*) FILTER (s.role = 'user') AS users, coalesce(sum({_HAN.format("s.text")}) FILTER (s.role = 'user'), 0) AS uhan,
    coalesce(sum({_LATIN.format("s.text")}) FILTER (s.role = 'user'), 0) AS ulatin FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN said s USING (conv_id) GROUP BY conv_id),
  r AS (SELECT 'cpt' AS target, doc_id AS id, length(text) AS body, {_HAN.format("text")} AS han, {_LATIN.format("text")} AS latin, 0 AS users, 0 AS uhan, 0 AS ulatin FROM documents
    UNION ALL SELECT 'sft', id, body, han, latin, users, uhan, ulatin FROM talks
    UNION ALL SELECT 'agent_negative', id, body, han, latin, users, uhan, ulatin FROM talks WHERE id % 9 = 0),
  f AS (SELECT target, id % {SHARDS} AS shard, body, CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END AS thought, id % 11 = 0 AS image, target = 'agent_negative' AS tool,
    {_LANG.format("han", "latin")} AS languages, CASE WHEN users = 0 THEN 'none' ELSE {_LANG.format("uhan", "ulatin")} END AS user_languages,
    CASE WHEN users < 3 THEN users::VARCHAR WHEN users < 6 THEN '3–5' ELSE '6+' END AS turns, {_BIN.format("body")} AS lengths FROM r),
  t AS (FROM f UNION ALL SELECT * REPLACE ('total' AS target) FROM f WHERE target <> 'agent_negative'),
  h AS (SELECT target, h, bin, count(*) AS n FROM (UNPIVOT (SELECT target, languages, user_languages, turns, lengths FROM t) ON languages, user_languages, turns, lengths INTO NAME h VALUE bin) GROUP BY ALL)
SELECT target, count(*) AS rows, sum(body)::BIGINT AS body_chars, sum(thought)::BIGINT AS reasoning_chars, count(*) FILTER (thought > 0) AS reasoning_rows,
  count(*) FILTER (image) AS image_rows, count(*) FILTER (tool) AS tool_rows,
  (SELECT string_agg(h.h || ' ' || bin || '=' || n, ';' ORDER BY h.h, bin) FROM h WHERE h.target = t.target) AS histograms,
  (SELECT count(DISTINCT (target, shard)) FROM f WHERE shard = {SHARDS - 1}) AS read_again, (SELECT count(DISTINCT (target, shard)) FROM f) AS files
FROM t GROUP BY target"""


@query("a5_cached_statistics", A5_SQL)
def a5(spark, d):
    """All shards but the last are counted first; the second run reads the last one's files alone."""
    path, cache = _folder(spark, "records"), _folder(spark, "statistics")
    rows = records(spark, d).repartition("target", "shard")

    def write(part):
        part.write.partitionBy("target", "shard").mode("append").json(path)

    def read(paths):
        found = spark.read.schema(distribution.RECORD).json(paths)
        at = F.col("_metadata.file_path")
        return found.withColumns({"file": at, "target": F.regexp_extract(at, r"target=(\w+)/", 1)})

    write(rows.filter(F.col("shard") < SHARDS - 1))
    distribution.cached(spark, path, cache, read, "*.json")
    write(rows.filter(F.col("shard") == SHARDS - 1))
    report, got = distribution.cached(spark, path, cache, read, "*.json")
    told = [
        F.expr(f"transform(filter(map_entries({h}), e -> e.value > 0), e -> concat('{h} ', e.key, '=', e.value))")
        for h in ("languages", "lengths", "turns", "user_languages")
    ]
    histograms = F.concat_ws(";", *(F.array_sort(x) for x in told)).alias("histograms")
    return report.select("target", *distribution.SUMS, histograms, F.lit(got.read).alias("read_again"), F.lit(got.files).alias("files"))


# --- histories imported by file ----------------------------------------------------------------


@query("l10_history_import", f"""WITH {SEED}, {ONE}, n AS (SELECT position, expression, CASE WHEN contains(expression, ' + ') THEN '["+",' ||
  array_to_string(list_sort(list_transform(string_split(expression, ' + '), lambda x: '["int",' || x || ']')), ',') || ']' WHEN contains(expression, ' * ') THEN '["*",' ||
  array_to_string(list_sort(list_transform(string_split(expression, ' * '), lambda x: '["int",' || x || ']')), ',') || ']' WHEN contains(expression, ' - ') THEN '["-",["int",' ||
  replace(expression, ' - ', '],["int",') || ']]' ELSE '["//",["int",' || replace(expression, ' // ', '],["int",') || ']]' END AS tree FROM o),
  f AS (SELECT position, position % 6 AS file, expression, sha256(encode('arithmetic-expression-v1') || '\\x00'::BLOB || encode(tree)) AS fingerprint FROM n
    WHERE position % 6 NOT IN (1, 4) AND (position % 6 <> 2 OR position % 12 = 2))
  SELECT fingerprint, min(file) AS file, min_by(position, (file, position)) AS position, min_by(expression, (file, position)) AS expression, 6 AS files, 3 AS read_again FROM f GROUP BY 1""")
def l10(spark, d):
    """Positions are dealt to six files.  Four are imported; then file 2 is written again with half of its rows
    and files 4 and 5 come: three files are read.  Files 1 and 4 hold a wrong answer each, so they add nothing."""
    path, cache = _folder(spark, "histories"), _folder(spark, "ledger")
    e, r = arithmetic.one_step(F.col("seed"))
    rows = seeds(spark, d).select("position", F.pmod("position", F.lit(6)).alias("file"), e.alias("expression"), r.alias("result"))
    said = arithmetic.one_step_answer(F.col("expression"), F.col("result"))
    wrong = F.col("file").isin(1, 4) & F.col("position").isin(*range(12))
    rows = rows.withColumn("answer", F.when(wrong, F.regexp_replace(said, "#### ", "#### 9")).otherwise(said)).drop("result").repartition("file")
    partial = F.col("file") == 2

    def write(part):
        part.write.partitionBy("file").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)

    write(rows.filter(F.col("file") < 4))
    history_import.imported(spark, path, cache, "*.json")
    write(rows.filter((partial & (F.pmod("position", F.lit(12)) == 2)) | (F.col("file") > 3)))
    got = history_import.imported(spark, path, cache, "*.json")
    number = F.regexp_extract("file", r"file=(\d+)/", 1).cast("bigint").alias("file")
    return got.ledger.select("fingerprint", number, "position", "expression", F.lit(got.files).alias("files"), F.lit(got.read).alias("read_again"))


# --- answers that are the same number ----------------------------------------------------------


@query(
    "g6_numeric_equivalence",
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_orderkey % 8 AS kind, round(l_discount * 100)::BIGINT AS a, round(l_tax * 100)::BIGINT AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN kind = 6 OR kind = 7 AND b = 0 THEN 'unresolved' WHEN kind = 5 AND a <> b OR kind = 7 AND a * b <> a THEN 'mismatched' ELSE 'matched' END AS status,
    CASE WHEN kind = 6 THEN 'not_a_unitless_numeric_expression' WHEN kind = 7 AND b = 0 THEN 'expression_not_fully_resolved'
    WHEN kind = 5 AND a <> b OR kind = 7 AND a * b <> a THEN 'numeric_inequality' ELSE 'numeric_equivalence' END AS reason FROM n""",
)
def g6(spark, d):
    """A discount as decimal against itself as percentage, fraction, reduced by three, formula, signed; against
    the tax; with a word; and as a quotient of discount and tax."""
    a, b = (F.round(F.col(c) * 100).cast("bigint") for c in ("l_discount", "l_tax"))
    n, kind = a.cast("string"), F.col("l_orderkey") % 8
    written = F.format_string("%.2f", "l_discount")
    forms = [
        F.concat(n, F.lit("%")), F.concat(F.lit("\\frac{"), n, F.lit("}{100}")), F.concat((a * 3).cast("string"), F.lit("/300")),
        F.concat(F.lit("$"), F.format_string("%.4f", "l_discount"), F.lit("$")), F.concat(F.lit(" +"), n, F.lit("\\% ")),
        F.format_string("%.2f", "l_tax"), F.concat(F.lit("about "), written), F.concat(written, F.lit("/"), b.cast("string")),
    ]
    candidate = F.element_at(F.array(*forms), kind.cast("int") + 1)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", written.alias("expected"), candidate.alias("candidate"))
    return equivalence.compared(rows, "expected", "candidate").select("l_orderkey", "l_linenumber", "status", "reason")


# --- observations and gates --------------------------------------------------------------------

ACTIONS = ("claim", "bind", "propose", "fail", "release")
_ACTION = "(['claim', 'bind', 'propose', 'fail', 'release'])[(event_id * 7 % 11 + user_id) % 5 + 1]"
_MOVE = " ".join(f"WHEN '{s}/{a}' THEN '{t}'" for (s, a), t in observations.OBSERVATIONS.items())


def observed(spark, d):
    """Eight events in a row are the actions on one observation; the first one's type is its outcome."""
    at = F.expr("(event_id * 7 % 11 + user_id) % 5 + 1").cast("int")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), at)
    return table(spark, d, "events").select(F.expr("event_id div 8").alias("observation"), "event_id", "event_type", action.alias("action"))


_ENDS = f"""a AS (SELECT event_id // 8 AS observation, event_id, event_type, {_ACTION} AS action FROM events),
  e AS (SELECT observation, min_by(event_type, event_id) AS outcome,
    list_reduce(list_concat(['pending'], list(action ORDER BY event_id)), lambda s, x: CASE s || '/' || x {_MOVE} ELSE s END) AS state FROM a GROUP BY observation)"""


@query("l5_observation_progress", f"WITH {_ENDS} SELECT 'all' AS scope, state, outcome, count(*) AS count, (sum(count(*)) OVER ())::BIGINT AS total FROM e GROUP BY state, outcome")
def l5(spark, d):
    actions = observed(spark, d)
    ends = observations.folded(actions, observations.OBSERVATIONS, ["observation"], "event_id")
    outcome = actions.groupBy("observation").agg(F.min_by("event_type", "event_id").alias("outcome"))
    return observations.progress(ends.join(outcome, "observation").withColumn("scope", F.lit("all")), "scope")


@query(
    "l5_claim_batch",
    """WITH p AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE doc_id % 3 = 1),
    n AS (SELECT *, 1 + sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) AS needed FROM p WHERE place <= 12)
    SELECT source, doc_id, CASE WHEN needed <= 9000 THEN 'claimed' ELSE 'needs_capacity' END AS status, needed::BIGINT AS characters FROM n WHERE needed <= 9000 OR place = 1""",
)
def l5_claim(spark, d):
    """The next batch of each source's documents: twelve at most, 9,000 characters as one array."""
    pending = table(spark, d, "documents").filter("doc_id % 3 = 1").select("source", "doc_id", "n_chars")
    return observations.claimable(pending, "source", "doc_id", "n_chars", 12, 9000)


GATE_TABLE = {"G0": False, "G1": True, "G3": False}
_GATE = "(['G0', 'G1', 'G2', 'G3'])[event_id % 4 + 1]"
_DECIDED = "(['propose', 'approve', 'reject', 'withdraw'])[event_id * 5 % 7 % 4 + 1]"


@query(
    "l4_gates",
    f"""WITH e AS (SELECT user_id, event_id, {_GATE} AS gate, {_DECIDED} AS action FROM events),
    last AS (SELECT user_id, gate, max_by(action, event_id) AS action FROM e WHERE action <> 'withdraw' GROUP BY ALL),
    g AS (SELECT user_id, gate, gate = 'G1' AS auto FROM (SELECT DISTINCT user_id FROM e), (SELECT unnest(['G0', 'G1', 'G3']) AS gate)),
    s AS (SELECT user_id, gate, CASE WHEN auto THEN 'approved' ELSE coalesce(CASE action WHEN 'propose' THEN 'awaiting' WHEN 'approve' THEN 'approved' ELSE 'rejected' END, 'pending') END AS status
      FROM g LEFT JOIN (SELECT * FROM last WHERE action IS NOT NULL) USING (user_id, gate))
    SELECT user_id, gate, status, status <> 'approved' AS blocked FROM s""",
)
def l4(spark, d):
    gate = F.element_at(F.array(*map(F.lit, ("G0", "G1", "G2", "G3"))), F.expr("event_id % 4 + 1").cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("propose", "approve", "reject", "withdraw"))), F.expr("event_id * 5 % 7 % 4 + 1").cast("int"))
    events = table(spark, d, "events").select("user_id", "event_id", gate.alias("gate"), action.alias("action"))
    return observations.gates(GATE_TABLE, events, ["user_id"], "event_id")


# --- identities of questions -------------------------------------------------------------------

_Q = "trim(nfc_normalize(replace(text, chr(13), chr(10))), E' \\n\\t')"


@query(
    "d19_question_identities",
    f"""WITH q AS (SELECT conv_id, turn, sha256(to_json([{_Q}, role, 'answer', 'open book'])::VARCHAR) AS contract, sha256(to_json([{_Q}, role])::VARCHAR) AS task, sha256(text) AS sent FROM conversations)
    SELECT conv_id, turn, contract, task, CASE turn % 3 WHEN 0 THEN contract WHEN 1 THEN sha256('["' || contract || '","' || sent || '"]') ELSE sha256('["actual_training_input_v1","' || sent || '"]') END AS actual FROM q""",
)
def d19(spark, d):
    """The three identities of every turn as a question in the context of its role."""
    turns = table(spark, d, "conversations")
    contract = history.contract_identity(F.concat("text", F.lit(" \n")), F.col("role"), F.lit(None).cast("string"), F.lit(" Open  BOOK?"))
    task = history.learner_task_identity(F.col("text"), F.col("role"))
    sent = F.when(F.col("turn") % 3 != 0, F.sha2("text", 256))
    rows = turns.select("conv_id", "turn", contract.alias("contract"), task.alias("task"), sent.alias("sent"))
    actual = history.actual_input_identity(F.col("contract"), F.col("sent"), F.col("turn") % 3 == 2)
    return rows.select("conv_id", "turn", "contract", "task", actual.alias("actual"))


# --- samples of terms --------------------------------------------------------------------------


@query(
    "t4_term_sample",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
    r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY md5(term), term) AS place FROM w) SELECT * FROM r WHERE place <= 48""",
)
def t4(spark, d):
    """The sample where terms are rows, by a hash that SQL has too.  A document's own sample comes first, so that
    its other words are never rows."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", F.explode(history.least(words, F.md5)).alias("w"))
    return history.bottom(rows.select("doc_id", "w.term").withColumn("hash", F.md5("term")), "doc_id", "term", "hash")


@query("k3_similar_questions")
def k3(spark, d):
    """Users' turns as questions: every twentieth is asked against all; the limits are the search's own."""
    turns = table(spark, d, "conversations").filter("role = 'user'")
    questions = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("question"))
    indexed = history.index(questions)
    return history.similar(indexed, indexed.filter("row_id % 20 = 0"))


# --- inputs and style pairs --------------------------------------------------------------------


@query(
    "a22_input_summary",
    """WITH u AS (SELECT source, CASE WHEN doc_id % 5 = 1 THEN 'quarantined' WHEN doc_id % 7 = 2 THEN 'skipped' WHEN doc_id % 11 = 3 THEN NULL ELSE 'ready' END AS status FROM documents),
    s AS (SELECT source, count(*) AS units, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'skipped') AS skipped FROM u GROUP BY source)
    SELECT *, greatest(0, ready - 20) AS deferred FROM s""",
)
def a22(spark, d):
    k = F.col("doc_id")
    status = F.when(k % 5 == 1, "quarantined").when(k % 7 == 2, "skipped").when(k % 11 == 3, F.lit(None)).otherwise("ready")
    return stats.input_summary(table(spark, d, "documents").select("source", status.alias("status")), "status", 20, "source")


@query(
    "q5_style_pairs",
    """WITH m AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 5 AS score FROM conversations),
    w AS (SELECT conv_id, turn, r, text || ' v' || r AS content, (conv_id * 3 + turn + r * 2) % 6 AS score FROM m, range(1, 4) t(r) WHERE role = 'assistant'),
    h AS (SELECT *, min(r) FILTER (score >= 4) OVER (PARTITION BY conv_id, turn) AS last FROM w),
    b AS (SELECT conv_id, turn, arg_max(content, score * 10 - r) AS chosen, max(score) AS best FROM h WHERE last IS NULL OR r <= last GROUP BY ALL)
    SELECT 'style-' || left(sha256(chosen), 16) AS id, conv_id AS sample, turn AS position, chosen, text AS rejected,
    (SELECT coalesce(string_agg(u.text, chr(31) ORDER BY u.turn), '') FROM m u WHERE u.conv_id = m.conv_id AND u.role = 'user' AND u.turn < m.turn) AS prompt
    FROM m JOIN b USING (conv_id, turn) WHERE role = 'assistant' AND score < 4 AND best > score""",
)
def q5(spark, d):
    """Three rewrites of each answer, scores by number."""
    turns = table(spark, d, "conversations")
    messages = turns.select(F.col("conv_id").alias("sample"), F.col("turn").alias("position"), "role", F.col("text").alias("content"), ((F.col("conv_id") + F.col("turn")) % 5).alias("score"))
    rounds = messages.filter("role = 'assistant'").withColumn("round", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    text = F.concat("content", F.lit(" v"), F.col("round").cast("string"))
    rewrites = rounds.select("sample", "position", "round", text.alias("content"), ((F.col("sample") * 3 + F.col("position") + F.col("round") * 2) % 6).alias("score"))
    return preference.style_pairs(messages, rewrites).withColumn("prompt", F.array_join("prompt", "\x1f"))


# --- packs filled in order ---------------------------------------------------------------------


@query(
    "c14_filled_packs",
    """WITH RECURSIVE u AS MATERIALIZED (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
    p AS (SELECT source, min(doc_id) AS doc_id, 0 AS before, 0 AS pack FROM u GROUP BY source
      UNION ALL SELECT p.source, n.doc_id, n.before, p.pack + 1 FROM p, LATERAL (SELECT doc_id, before FROM u WHERE u.source = p.source AND u.doc_id > p.doc_id AND u.before + u.n_chars > p.before + 20000 ORDER BY doc_id LIMIT 1) n)
    SELECT u.source, u.doc_id, max(p.pack)::BIGINT AS pack FROM u JOIN p ON p.source = u.source AND p.doc_id <= u.doc_id GROUP BY ALL""",
)
def c14(spark, d):
    """Packs of 20,000 characters, each filled before the next begins."""
    return packs.filled(table(spark, d, "documents"), "source", "doc_id", "n_chars", 20_000)


# --- quotes, memories, production --------------------------------------------------------------


@query(
    "c11_quotes_bound",
    r"""WITH d AS (SELECT doc_id, text, substring(text, 6, 40) AS q, regexp_replace(substring(text, 6, 40), '\s+', '', 'g') AS f FROM documents),
    p AS (SELECT *, strpos(text, q) - 1 AS exact, strpos(text, f) - 1 AS bare, list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(text[i], '\s')) AS places, strpos(regexp_replace(text, '\s+', '', 'g'), f) AS dense FROM d WHERE length(text) < 2000)
    SELECT doc_id, CASE WHEN f = '' THEN NULL ELSE exact::BIGINT END AS first_start, CASE WHEN f = '' THEN NULL WHEN bare >= 0 THEN bare::BIGINT ELSE places[dense] - 1 END AS second_start,
    CASE WHEN f = '' THEN NULL WHEN bare >= 0 THEN bare + length(f) ELSE places[dense + length(f) - 1] END::BIGINT AS second_end, CASE WHEN f = '' THEN NULL WHEN bare >= 0 THEN 'exact' ELSE 'pdf_whitespace' END AS match FROM p
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM documents WHERE length(text) >= 2000""",
)
def c11(spark, d):
    """A piece of each document as it is and without its white space; long ones count as no PDF text, so their
    second quote must stand there exactly (and the whole answer is null where it does not)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    piece = F.substring("text", 6, 40)
    bare = F.regexp_replace(piece, r"\s+", "")
    asked = F.array(piece, F.when(F.length("text") < 2000, bare).otherwise(F.lit("\u0001absent")))
    spans = docs.select("doc_id", quotes.quote_spans(F.col("text"), asked, F.length("text") < 2000).alias("s"))
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    return spans.select("doc_id", first["start"].alias("first_start"), second["start"].alias("second_start"), second["end"].alias("second_end"), second["match"].alias("match"))


@query(
    "k5_memory_by_content",
    """SELECT lang, left(text, 12) AS opening, list_transform(list_sort(list_distinct(list({'d': sha256(source), 's': source}))), lambda x: x.s) AS sources, count(*) AS entries FROM documents GROUP BY ALL""",
)
def k5(spark, d):
    """Documents of one language and opening are one memory; its sources are all theirs."""
    entries = table(spark, d, "documents").select("lang", F.substring("text", 1, 12).alias("opening"), "source")
    return ledgers.merged_memory(entries, ["lang", "opening"], "source").drop("id")


GOALS = {"click": 1500, "view": 100_000, "unheard": 7}


@query(
    "a21_production_state",
    f"""WITH g AS (SELECT unnest({list(GOALS)}) AS target, unnest({list(GOALS.values())})::BIGINT AS goal),
    r AS (SELECT event_type AS target, count(*) FILTER (value > 20) AS eligible, count(*) AS attempted, count(DISTINCT event_id // 500) AS rounds FROM events GROUP BY 1)
    SELECT target, goal, coalesce(eligible, 0) AS eligible, coalesce(attempted, 0) AS attempted, greatest(0, goal - coalesce(eligible, 0)) AS remaining, coalesce(rounds, 0) AS rounds FROM g LEFT JOIN r USING (target)""",
)
def a21(spark, d):
    """Five hundred events are a round's receipts; values above twenty are eligible."""
    receipts = table(spark, d, "events").groupBy(F.col("event_type").alias("target"), F.expr("event_id div 500").alias("round"))
    receipts = receipts.agg(F.count_if(F.col("value") > 20).alias("eligible"), F.count("*").alias("attempted"))
    return stats.production_state(receipts, GOALS)
