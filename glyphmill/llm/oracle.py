"""SQL, in DuckDB's dialect, for the operators whose results SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, w[i:i + 7] AS x, least(len(w), 8) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, w[i:i + n - 1] AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
f AS (SELECT dw.r, dw.i, dw.n, iw.item FROM dw JOIN iw ON dw.x = iw.x),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM f) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN g ON d.r = g.r
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, w[i:i + 3] AS x
  FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
links AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b
  FROM common JOIN n p ON p.r = a JOIN n q ON q.r = b JOIN d x ON x.r = a JOIN d y ON y.r = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS id, doc_id AS least_id FROM d
  UNION
  SELECT links.b, reach.least_id FROM reach JOIN links ON links.a = reach.id WHERE reach.least_id < links.b),
c AS (SELECT id, min(least_id) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.r = d.r JOIN c ON c.id = d.doc_id
"""

OP3_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (
  SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS k
  FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
s AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
f AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true) AS new FROM s),
g AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
u AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
v AS (SELECT u.*, coalesce(lag(b) OVER (PARTITION BY u.r ORDER BY a), 0) AS before FROM u),
t AS (
  SELECT v.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM v JOIN d ON d.r = v.r GROUP BY v.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r
"""
