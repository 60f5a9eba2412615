"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from .url_filter import LONG_SUFFIXES

#: Fixed value: the ASCII white space that separates words, as DuckDB's regular expressions write it.
SPACE = r"[ \t\n\x0B\f\r]"

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, i, l[i] AS line,
         {_LOWER.format(f"regexp_replace(regexp_replace(l[i], '^{SPACE}+', ''), '{SPACE}+$', '')")} AS k
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d), unnest(range(1, len(l) + 1)) AS u(i)
),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT lines.*, coalesce(lines.doc_id <> keeper, false) AS gone FROM lines LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') AS lines
  FROM documents
),
windows AS (
  SELECT r, i, w[i:i + 7] AS v FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i) WHERE len(w) >= 8
),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, v) >= 2),
cover AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM repeated),
covered AS (SELECT r, sum(n)::BIGINT AS n FROM cover GROUP BY r),
m AS (
  SELECT d.doc_id, d.t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines
  FROM d LEFT JOIN covered USING (r)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR 5 * n_symbols > n_words
         OR (n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
         OR 3 * len(regexp_extract_all(t, '[!?]{{2,}}')) > n_words
         OR 2 * len(regexp_extract_all(t, '\\p{{Lu}}')) > word_chars
         OR 2 * len(regexp_extract_all(t, '\\p{{Nd}}')) > word_chars
         OR 10 * len(regexp_extract_all(t, '(?m)(?:\\.\\.\\.|\u2026)[ \\t]*$')) > 3 * n_lines
         OR 10 * len(regexp_extract_all(t, '(?m)^[ \\t]*[-*\u2022]')) > 9 * n_lines) AS kept
FROM b
"""

_TWO = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
_THREE = "array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')"
_LONG = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)


def _kappa(table: str, n: str, good: str) -> str:
    return f"""
SELECT CASE WHEN k < 2 OR n <= k OR b + (n0 - 1) * w <= 0 THEN 9.0
            ELSE 1 / least(greatest((b - w) / (b + (n0 - 1) * w), 0.001), 0.5) - 1 END AS kappa
FROM (
  SELECT k, n, (q - s * s / nullif(n, 0)) / nullif(k - 1, 0) AS b, (s - q) / nullif(n - k, 0) AS w, (n - n2 / nullif(n, 0)) / nullif(k - 1, 0) AS n0
  FROM (SELECT count(*)::DOUBLE AS k, coalesce(sum({n}), 0)::DOUBLE AS n, coalesce(sum({good}), 0)::DOUBLE AS s,
               sum({n}::DOUBLE * {n}) AS n2, sum({good}::DOUBLE * {good} / {n}) AS q FROM {table})
)"""


OP8 = f"""
WITH p AS (
  SELECT page_id,
         {_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
o AS (
  SELECT doc_id AS ref, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
),
h AS (
  SELECT host, CASE WHEN {_TWO} IN ({_LONG}) THEN {_THREE} ELSE {_TWO} END AS domain,
         CASE WHEN {_TWO} IN ({_LONG}) THEN {_TWO} ELSE string_split(host, '.')[-1] END AS suffix
  FROM (SELECT DISTINCT host FROM p)
),
bh AS (
  SELECT host, domain, suffix, count(*)::BIGINT AS n, sum(good)::BIGINT AS good
  FROM p JOIN o ON try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT) = ref JOIN h USING (host) GROUP BY ALL
),
bd AS (SELECT domain, suffix, sum(n) AS nd, sum(good) AS gd FROM bh GROUP BY ALL),
bs AS (SELECT suffix, sum(nd) AS ns, sum(gd) AS gs FROM bd GROUP BY ALL),
ks AS ({_kappa("bs", "ns", "gs")}), kd AS ({_kappa("bd", "nd", "gd")}), kh AS ({_kappa("bh", "n", "good")}),
m AS (SELECT (coalesce(sum(gs), 0)::DOUBLE + 0.5) / (coalesce(sum(ns), 0)::DOUBLE + 1) AS m0 FROM bs),
r AS (
  SELECT h.host, coalesce(bh.n, 0) AS n, kh.kappa AS kh,
         (coalesce(bh.good, 0) + kh.kappa * ((coalesce(gd, 0) + kd.kappa * ((coalesce(gs, 0) + ks.kappa * m0) / (coalesce(ns, 0) + ks.kappa)))
           / (coalesce(nd, 0) + kd.kappa))) / (coalesce(bh.n, 0) + kh.kappa) AS mean
  FROM h CROSS JOIN m CROSS JOIN ks CROSS JOIN kd CROSS JOIN kh
  LEFT JOIN bh ON h.host = bh.host LEFT JOIN bd ON h.domain = bd.domain LEFT JOIN bs ON h.suffix = bs.suffix
),
f AS (
  SELECT page_id, p.host, path, mean - 1.645 * sqrt(mean * (1 - mean) / (n + kh + 1)) AS lower,
         CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN r ON p.host = r.host
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN lower >= 0.5 THEN 'allow' ELSE 'block' END AS verdict
FROM f
"""

#: All sets against all others that share a shingle, and every component by its links: for small tables.
OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS a, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT a, n, unnest(s) AS t FROM classes),
keys AS (SELECT t, row_number() OVER () AS k FROM (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1)),
small AS (SELECT a, n, k FROM tokens JOIN keys USING (t)),
links AS (SELECT x.a, y.a AS b FROM small x JOIN small y ON x.k = y.k AND x.a < y.a AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.a, y.a HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.c, doc_id) AS component_id, coalesce(classes.a, doc_id) AS class_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN comp ON comp.a = classes.a
"""

#: Every query against every row.
OP5 = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

ORACLES = {"op2_line_dedup": OP2, "op3_quality_rules": OP3, "op4_jaccard_join": OP4, "op5_exact_top_k": OP5, "op8_url_filter": OP8}
