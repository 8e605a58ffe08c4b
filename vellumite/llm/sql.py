"""SQL for DuckDB of the queries that SQL can express, written from their contracts."""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, UNNEST(range(1, greatest(len(w) - 2, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, (SELECT count(*) FROM links WHERE u = d.doc_id) AS n_links FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) c USING (doc_id)
"""

INT8_NEARDUP = r"""
WITH RECURSIVE used AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM used a JOIN used b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
comp AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp
"""

URL_FILTER = r"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, h, p)),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS ruled FROM (SELECT DISTINCT page_id, host, path FROM c) c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
d AS (SELECT c.*, rule, ruled, regexp_replace(host, '^.*@|:[0-9]*$|\.+(:[0-9]*)?$', '', 'g') AS site FROM c LEFT JOIN fits USING (page_id)),
labels_of AS (SELECT DISTINCT site, string_split(site, '.') AS l, CASE WHEN regexp_matches(site, '^[0-9]+(\.[0-9]+){3}$|^\[') THEN 0 WHEN regexp_matches(site, '(^|\.)(ac|co|com|edu|gob|gouv|gov|go|gv|mil|ne|net|nom|or|org|sch)\.[a-z][a-z]$') THEN 2 ELSE 1 END AS k FROM d),
hosts AS (SELECT d.site AS host, count(ruled) AS n, coalesce(sum((ruled = 'block')::INT), 0) AS b, any_value(CASE k WHEN 0 THEN d.site WHEN 2 THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END) AS domain, any_value(CASE k WHEN 0 THEN d.site WHEN 2 THEN array_to_string(l[-2:], '.') ELSE l[-1] END) AS suffix FROM d JOIN labels_of USING (site) GROUP BY d.site),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
units AS (SELECT 1 AS lvl, n::DOUBLE AS n, b::DOUBLE AS b FROM suffixes WHERE n > 0 UNION ALL SELECT 2, n, b FROM domains WHERE n > 0 UNION ALL SELECT 3, n, b FROM hosts WHERE n > 0),
sums AS (SELECT lvl, count(*) AS j, sum(n) AS n, sum(b) AS b, sum(n * n) AS sq, sum(b) / sum(n) AS m FROM units GROUP BY lvl),
spreads AS (SELECT s.lvl, s.j, s.n, s.b, s.m, (sum(u.n * (u.b / u.n - s.m) ** 2) - (s.j - 1) * s.m * (1 - s.m)) / nullif(s.n - s.sq / s.n, 0) AS v FROM sums s JOIN units u ON s.lvl = u.lvl GROUP BY s.lvl, s.j, s.n, s.b, s.sq, s.m),
k AS (SELECT l.lvl, CASE WHEN j >= 2 AND b > 0 AND b < n AND v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM (VALUES (1), (2), (3)) l(lvl) LEFT JOIN spreads USING (lvl)),
s2 AS (SELECT suffix, (b + k * ((SELECT sum(b) FROM suffixes) + 1) / ((SELECT sum(n) FROM suffixes) + 2)) / (n + k) AS above FROM suffixes, k WHERE lvl = 1),
d2 AS (SELECT domain, (b + k * above) / (n + k) AS prior FROM domains JOIN s2 USING (suffix), k WHERE lvl = 2),
h2 AS (SELECT host, n, k, (b + k * prior) / (n + k) AS mean FROM hosts JOIN d2 USING (domain), k WHERE lvl = 3)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(mean - 1.645 * sqrt(mean * (1 - mean) / (n + k + 1)), 9) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM d JOIN (SELECT host AS site, * EXCLUDE (host) FROM h2) h USING (site)
"""
