"""DuckDB SQL for the queries of this package that SQL can express."""

# Words, and the places where eight-word windows repeat inside one text.
_QUALITY = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT rid, i, list_slice(w, i, i + 7) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT rid, sum(least(8, coalesce(i - before, 8))) AS n
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM rep) GROUP BY rid),
lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (
  SELECT w.doc_id, w.w, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l.l) AS n_lines, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(w.w, lambda x: ends_with(x, '!!'))) AS loud,
         len(list_filter(range(2, len(w.w) + 1), lambda i: w.w[i] = w.w[i - 1])) AS runs
  FROM w JOIN lines l USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 100 > n_lines * 60 OR loud * 10 > n_words * 3
            OR word_chars < n_words * 2 OR word_chars > n_words * 20 OR runs * 100 > n_words * 30) AS kept
FROM b
"""

_URLS = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
q AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT rid, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
  FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.rv, 'allow') AS verdict
FROM q LEFT JOIN f ON q.rid = f.rid AND f.k = 1
"""

_NEGATIVES = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same AND id <> anchor_id)
  WHERE k <= 5),
w AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE k <= 5
"""

_PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
cover AS (
  SELECT DISTINCT x.lang, x.part FROM (
    SELECT c.lang, c.f, list_slice(c.g, i, i + k - 1) AS part
    FROM f c, range(2, 5) AS t(k), range(1, 5) AS u(i) WHERE k < len(c.g) AND i + k - 1 <= len(c.g)) x
  JOIN f ON f.lang = x.lang AND f.g = x.part WHERE 100 * x.f >= 100 * f.f),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, n.n,
         CAST(1000 * CAST(c.f AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS BIGINT) AS score
  FROM f c JOIN range(1, 5) AS t(k) ON k < len(c.g)
  JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, k)
  JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, k + 1, len(c.g))
  JOIN n ON n.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM cover WHERE cover.lang = c.lang AND cover.part = c.g)),
best AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS q FROM cuts) WHERE q = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""

ORACLE = {"op2_quality_rules": _QUALITY, "op3_url_filters": _URLS, "op12_hard_negatives": _NEGATIVES, "op13_collocations": _PHRASES}
