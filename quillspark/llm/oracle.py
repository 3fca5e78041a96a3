"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM u
), r(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""

#: Mixing from rows (k, size, source) in a table ``sized``; k is a row's key, unique.
MIX = r"""
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source
), c AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM s
), o AS (
  SELECT *, 3 * source_size * weights > rest * weight AS open,
         3 * source_size AS most, source_size / weight AS ratio
  FROM c
), l AS (
  SELECT arg_min(rest, ratio) AS rest, arg_min(weights, ratio) AS weights FROM
    (SELECT rest, weights, row_number() OVER (ORDER BY ratio, source NULLS FIRST) AS ratio FROM o WHERE open)
), t AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.open THEN (o.weight * l.rest)::DOUBLE / l.weights ELSE o.most::DOUBLE END AS target
  FROM o, l
), q AS (
  SELECT d.k, d.size, t.source, t.source_size, t.target, p.pass, md5('mix:' || coalesce(d.k::VARCHAR, '')) AS h,
         (p.pass * t.source_size + sum(d.size) OVER (PARTITION BY d.source, p.pass ORDER BY md5('mix:' || coalesce(d.k::VARCHAR, '')), d.k, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1), (2)) p(pass)
), f AS (
  SELECT *, upto::DOUBLE / target AS finish FROM q WHERE target > 0 AND pass < ceil(target / source_size)
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, pass, h, k, size ROWS UNBOUNDED PRECEDING) AS total FROM f
), n AS (
  SELECT k, count(*) AS copies FROM g WHERE total <= (SELECT sum(size) FROM sized) GROUP BY k
)"""

OP9 = rf"""
WITH sized AS (
  SELECT doc_id AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, source FROM documents
), {MIX}
SELECT d.k AS doc_id, d.size, t.source_size, t.target, (coalesce(n.copies, 0) * d.size)::BIGINT AS taken
FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON n.k = d.k
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), g AS (
  SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""

#: The checksum of a number's decimal digits is worked out by bits: DuckDB has no function for it.
OP13 = r"""
WITH bits AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
), told AS (
  SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS size, left(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id, size) AS ids, list(size ORDER BY turn NULLS FIRST, id, size) AS sizes FROM told GROUP BY conv_id
), h AS (
  SELECT t.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h FROM t, bits
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.ids[:h.h], []), h.ids[h.h + 1:]) AS ids, list_concat(coalesce(b.sizes[:h.h], []), h.sizes[h.h + 1:]) AS sizes
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, d, ids[:d] AS k, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(ids) AS ends FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM r)
), n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, k[:d - 1] AS k, count(*)::BIGINT AS n_children FROM n WHERE d > 0 GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)
), s AS (
  SELECT a AS d, k[:a] AS k, count_if(n_children = 0)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL
)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.k = m.k LEFT JOIN m up ON up.d = m.d - 1 AND up.k = m.k[:m.d - 1]
"""

ORACLE: dict[str, str] = {"op1_url_filter": OP1, "op9_mixing": OP9, "op10_exact_dedup": OP10, "op13_prefix_trie": OP13}
