"""SQL twins, for DuckDB, of the queries that SQL can express over the tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HTML = r"""WITH b AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
s AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS plain FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(plain, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS text FROM s)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * i >= 80 * (cx.n + cy.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, k) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.k = e.x)
SELECT r.doc_id, CAST(coalesce(max(c.n), 0) AS BIGINT) AS n_shingles, min(k) AS component_id FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, k) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.k = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT r.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(k) AS component_id, r.vec_id = min(k) AS kept FROM r LEFT JOIN n ON n.x = r.vec_id GROUP BY r.vec_id"""
