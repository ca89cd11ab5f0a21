"""The SQL that states op3's result: sets, links by shared shingles, and reachability."""

from __future__ import annotations

from .near_dedup import LOWER, UPPER

ORACLE_SQL = {
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, t) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t),
c AS (SELECT v, min(t) AS t FROM r GROUP BY v),
o AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(t, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""
}
