"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

import string

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRET_SCANS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, 0 AS kind, 'assign' AS name, string_split_regex(t, '{ASSIGN}') AS gaps, regexp_extract_all(t, '{ASSIGN}', 0) AS found, regexp_extract_all(t, '{ASSIGN}', 2) AS body, 6 AS least FROM d
  UNION ALL SELECT doc_id, 1, 'access', string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), 20 FROM d
  UNION ALL SELECT doc_id, 2, 'hex', string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), 24 FROM d),
i AS (SELECT doc_id, kind, name, least, unnest(range(1, len(found) + 1)) AS n, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS hit, unnest(body) AS body FROM k),
s AS (SELECT *, sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS start FROM i WINDOW w AS (PARTITION BY doc_id, kind ORDER BY n)),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, kind) AS spans
  FROM s WHERE length(body) >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN g USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x FROM d),
n AS MATERIALIZED (SELECT doc_id, len(x) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(x) AS y FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.y = b.y AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM n LEFT JOIN c ON a = doc_id
"""
