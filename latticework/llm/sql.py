"""DuckDB SQL of the queries that SQL can express, over the same tables."""

OP9 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS k,
             min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
             sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s),
v AS (SELECT *, (total * 150 / 100 - stopped) / open_weight AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(CAST(2 * source_size AS DOUBLE), weight * max(CASE WHEN level * weight <= 2 * source_size THEN level END) OVER ()), CAST(2 * source_size AS DOUBLE)) AS target FROM v),
e AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(round(t.target / t.source_size * 1048576) AS BIGINT) ELSE 0 END AS expected,
             CAST('0x' || left(md5('mix-1' || coalesce('=' || t.source, 'null')), 5) AS BIGINT) % 1048576 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, u + sum(expected) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target,
       CAST((upto // 1048576 - (upto - expected) // 1048576) * size AS BIGINT) AS taken FROM p
"""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
y AS (SELECT r, i, a, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM x),
z AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM y WHERE c IS NOT NULL) WHERE n > 1),
q AS (SELECT r, count(*) AS n FROM (SELECT r, i FROM z UNION SELECT r, i + 1 FROM z UNION SELECT r, i + 2 FROM z) GROUP BY r),
l AS (SELECT r, unnest(ls) AS line FROM w),
m AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l),
j AS (SELECT r, len(lw) AS n, len(list_filter(lw, lambda v: regexp_matches(v, '[#*$%&<>]|[!?][!?]'))) AS noisy,
             len(list_filter(lw, lambda v: v IN ('|', '>', '»', '•', '·'))) AS seps,
             regexp_matches(line, '(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|subscribe to our newsletter|click here|licensed under|share on (?:facebook|twitter)|skip to (?:main )?content|^copyright |^©') AS notice FROM m),
k AS (SELECT r, CAST(sum(n) AS BIGINT) AS lost FROM j WHERE 100 * noisy >= 30 * n OR (seps > 1 AND 5 * seps >= n) OR (notice AND n <= 30) GROUP BY r),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words, coalesce(k.lost, 0) AS n_lost_words
      FROM w LEFT JOIN q USING (r) LEFT JOIN k USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM g
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first_id, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN first_id END AS refers_to FROM q
"""

OP11 = r"""
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM r),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
