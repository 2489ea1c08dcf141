"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from millrace.llm.quality_rules import BIT, POLICIES, RULES

SPLIT = "list_filter(regexp_split_to_array({0}, '{1}+'), lambda x: x <> '')"
WORDS = SPLIT.format("t", r"[ \x09-\x0D]")
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH_WORDS = SPLIT.format(LOW, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _spans(kind: str, pattern: str, rank: int, keep: str = "true") -> str:
    """doc_id, kind, rank, start, end, hit, t of the matches that ``keep`` holds for."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s AS start, s + length(hit) AS "end", hit, t FROM (SELECT doc_id, t, hits[i] AS hit,
      (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)) WHERE {keep}"""


DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN {DIGITS}[i]::INT
  ELSE 2 * {DIGITS}[i]::INT - CASE WHEN {DIGITS}[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
FLAT = "regexp_replace(hit, ' ', '', 'g')"
MOVED = f"({FLAT}[5:] || {FLAT}[:4])"
MOD97 = f"""list_reduce([0] || list_transform(string_split({MOVED}, ''), lambda c: ascii(c)), lambda a, v: CASE WHEN v < 58 THEN (a * 10 + v - 48) % 97 ELSE (a * 100 + v - 55) % 97 END) = 1"""
#: The words that raise a kind's score by 30 of 100, its prior, and the words that lower any.
KNOWN = {
    "email": (90, "mail|contact|write|address"), "ip": (60, "ip|host|server|address"), "card": (80, "card|visa|credit|payment"),
    "phone": (70, "phone|call|tel|mobile"), "iban": (70, "iban|account|bank"), "ssn": (30, "ssn|social|security"),
}


def _said(words: str) -> str:
    return f"CASE WHEN regexp_matches(substring(t, greatest(start - 40, 0) + 1, length(hit) + 80), '(?i)(^|[^a-z])({words})') THEN 30 ELSE 0 END"


SCORE = f"""least(100, CASE kind {' '.join(f"WHEN '{k}' THEN {n} + {_said(w)}" for k, (n, w) in KNOWN.items())} END - {_said("example|sample|dummy|fake|test|version|serial|invoice")})"""
PII = " UNION ALL ".join(
    [
        _spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0),
        _spans("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 1, "list_bool_and(list_transform(string_split(hit, '.'), lambda p: TRY_CAST(p AS HUGEINT) <= 255))"),
        _spans("card", "[0-9](?:[ -]?[0-9])+", 2, f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
        _spans("phone", r"\+[0-9][ ().0-9-]+[0-9]", 3, f"length({DIGITS}) BETWEEN 8 AND 15"),
        _spans("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", 4, MOD97),
        _spans("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 5),
    ]
)
_OUT = "kind || ':' || start || ':' || \"end\""

OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), every AS ({PII}), s AS (SELECT * FROM (SELECT *, {SCORE} AS score FROM every) WHERE rank < 4 OR score >= 50),
a AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone, string_agg({_OUT}, ',' ORDER BY rank, start) FILTER (rank < 4) AS base, string_agg({_OUT}, ',' ORDER BY rank, start) AS spans, count(*) FILTER (score >= 50) AS n_likely FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_likely, 0) AS n_likely, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""

VALUE = r"""regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)"""
SECRETS = " UNION ALL ".join(
    [
        _spans("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, f"length({VALUE}) >= 8"),
        _spans("access", "AKIA[A-Z0-9]+", 1, "length(hit) >= 16"),
        _spans("hex", "[0-9a-f]+", 2, "length(hit) >= 32"),
        _spans("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 3),
        _spans("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 4),
    ]
)
OP4 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({SECRETS}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({_OUT}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({_OUT}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""

LEDGER = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({SECRETS}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, t IN (SELECT t FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) AS known, coalesce(n, 0) AS n_findings FROM d LEFT JOIN n USING (doc_id)"""

OP8 = f"""WITH items AS (SELECT item_id, {BENCH_WORDS} AS w FROM benchmark), docs AS (SELECT doc_id, {BENCH_WORDS} AS w FROM documents),
windows AS (SELECT DISTINCT item_id, len(x) AS k, array_to_string(x, ' ') AS win FROM (SELECT item_id, w[i + 1:i + least(10, len(w))] AS x
  FROM items, range(10000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)))),
sizes AS (SELECT DISTINCT k FROM windows),
mine AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, w FROM docs, sizes WHERE len(w) >= k),
hits AS (SELECT doc_id, pos, m.k, item_id FROM mine m JOIN windows x ON x.k = m.k AND x.win = array_to_string(w[pos:pos + m.k - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)"""

_FAILS = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 15 * n_words",
    "duplicate_lines": "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "shouting": "2 * n_upper > n_letters",
    "no_letters": "2 * n_letters < word_chars",
}
_BITS = " + ".join(f"CASE WHEN {_FAILS[r]} THEN {BIT[r]} ELSE 0 END" for r in RULES)
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {POLICIES["base-1"]}) <> 0 AS base_failed,
  (fail_bits & {POLICIES["full-1"] | POLICIES["base-1"]}) = 0 AS kept, fail_bits FROM b"""

ORACLES = {"op2_pii": OP2, "secret_ledger": LEDGER, "op4_secret_scan": OP4, "op8_decontamination": OP8, "op9_quality_rules": OP9}
