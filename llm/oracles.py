"""SQL of the queries that SQL can express, by plain joins over whole tables.

Rows are told apart by their number, so ids that repeat or are null count as rows of their own. A group is the closure
of the links of its distinct sets or vectors, never of their copies.
"""

from __future__ import annotations

import string

_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Groups of linked items from a relation near(a, b) that holds both directions: item and the smallest head it reaches.
_REACH = """reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)"""

JACCARD = rf"""WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, list_sort(list_distinct(CASE
    WHEN coalesce(len(w), 0) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingles FROM listed),
keyed AS MATERIALIZED (SELECT r, doc_id, shingles, len(shingles) AS n, sha256(array_to_string(shingles, chr(10))) AS class FROM rows_),
classes AS MATERIALIZED (
  SELECT class, any_value(n) AS n, any_value(shingles) AS shingles, min(doc_id) AS head FROM keyed WHERE n > 0 GROUP BY class),
entries AS MATERIALIZED (SELECT class, n, unnest(shingles) AS s FROM classes),
near AS MATERIALIZED (
  SELECT x.class AS a, y.class AS b FROM entries x JOIN entries y ON x.s = y.s AND x.class <> y.class
  GROUP BY x.class, y.class, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
{_REACH},
tops AS (SELECT r.a AS class, min(c.head) AS head FROM reach r JOIN classes c ON c.class = r.b GROUP BY r.a)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles,
  CASE WHEN k.n = 0 THEN k.doc_id ELSE least(c.head, t.head) END AS component_id
FROM keyed k LEFT JOIN classes c ON c.class = k.class AND k.n > 0 LEFT JOIN tops t ON t.class = c.class"""

COSINE = f"""WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
able AS MATERIALIZED (
  SELECT r, vec_id, v FROM vectors WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
classes AS MATERIALIZED (SELECT min(r) AS class, v, count(*) AS times, min(vec_id) AS head FROM able GROUP BY v),
near AS MATERIALIZED (
  SELECT x.class AS a, y.class AS b FROM classes x JOIN classes y ON x.class <> y.class AND len(x.v) = len(y.v)
  WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) END >= 0.9),
{_REACH},
tops AS (SELECT r.a AS class, min(c.head) AS head FROM reach r JOIN classes c ON c.class = r.b GROUP BY r.a),
linked AS (SELECT n.a AS class, sum(c.times) AS times FROM near n JOIN classes c ON c.class = n.b GROUP BY n.a),
found AS (
  SELECT a.r, c.times - 1 + coalesce(l.times, 0) AS n_links, least(c.head, t.head) AS component_id
  FROM able a JOIN classes c ON c.v = a.v LEFT JOIN tops t ON t.class = c.class LEFT JOIN linked l ON l.class = c.class)
SELECT x.vec_id, CAST(coalesce(f.n_links, 0) AS BIGINT) AS n_links, CASE WHEN f.r IS NULL THEN x.vec_id ELSE f.component_id END AS component_id,
  x.vec_id IS NOT DISTINCT FROM CASE WHEN f.r IS NULL THEN x.vec_id ELSE f.component_id END AS kept
FROM vectors x LEFT JOIN found f ON f.r = x.r"""

ORACLE = {"op4_set_relation_join": JACCARD, "op5_metric_range_join": COSINE}
