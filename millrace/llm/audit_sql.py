"""DuckDB statements of the vector codes and of the source divergence audit."""

from __future__ import annotations

PARTS, ENTRIES, ROUNDS = 8, 16, 6

_ASSIGNED = """SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, c.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS d
    FROM parts p JOIN c{n} c USING (part)) GROUP BY ALL"""


def _round(n: int) -> str:
    """The codebooks after one more round; ``//`` of whole numbers rounds to zero, so it is mended to a floor."""
    return f"""a{n} AS MATERIALIZED ({_ASSIGNED.format(n=n)}),
  m{n} AS (SELECT part, entry, place, (s - ((s % k) + k) % k) // k AS x FROM (
    SELECT part, entry, place, sum(p.v[place])::HUGEINT AS s, count(*)::HUGEINT AS k
    FROM parts p JOIN a{n} USING (vec_id, part), (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS place) GROUP BY ALL)),
  c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN
    (SELECT part, entry, list(x::BIGINT ORDER BY place) AS v FROM m{n} GROUP BY ALL) m USING (part, entry))"""


VECTOR_CODES = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // {PARTS}) + 1:(part + 1) * (len(q) // {PARTS})] AS v
    FROM kept, (SELECT unnest(range({PARTS})) AS part)),
  firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
  c0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN firsts USING (vec_id)),
  {", ".join(_round(n) for n in range(ROUNDS))},
  last AS MATERIALIZED ({_ASSIGNED.format(n=ROUNDS)}),
  coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id),
  book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book"""

_SHARE = "1 + (1000000000 * ({0} + 2)::HUGEINT) // ({1} + 2 * v)::HUGEINT"

DIVERGENCE = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d),
  w AS MATERIALIZED (SELECT lang, source, doc, unnest(words) AS term FROM d),
  kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
  l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
  occ AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
  dense AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, {_SHARE.format("k.c", "l.n")} AS q, l.v,
    sum(coalesce(o.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
    FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
  p AS MATERIALIZED (SELECT lang, source, term, c, q, {_SHARE.format("c", "n")} AS p FROM dense),
  pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
  found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT * FROM (SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found) WHERE part = 'pair' OR rank <= 10"""
