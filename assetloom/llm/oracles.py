"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM src),
ratios AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS ratio FROM weighted),
running AS (
  SELECT *, CAST(sum(cap) OVER up AS BIGINT) - cap AS cap_before,
         CAST(sum(w) OVER () AS BIGINT) - CAST(sum(w) OVER up AS BIGINT) + w AS w_from,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM ratios WINDOW up AS (ORDER BY ratio, rn ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, CAST(3 * total - 2 * cap_before AS DOUBLE) / (2 * w_from) AS level FROM running),
targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rn LIMIT 1),
               CAST('infinity' AS DOUBLE)) * w) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM cut
"""

QUALITY_RULES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
         CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS host FROM documents),
named AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'r' || row ELSE 'd' || doc_id END AS document FROM docs),
limits AS (SELECT host, greatest(20, count(DISTINCT document) // 100) AS most FROM named GROUP BY host),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT row, unnest(range(1, greatest(len(w) - 1, 1))) AS i,
         unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM windows),
repeats AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c > 1) GROUP BY row),
lines AS (SELECT row, document, host, unnest(string_split(t, chr(10))) AS line FROM named),
worded AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY row),
normal AS (
  SELECT row, document, host, len(w) AS n,
         translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line FROM worded),
frequent AS (
  SELECT host, line FROM normal JOIN limits USING (host) GROUP BY host, line HAVING count(DISTINCT document) > any_value(most)),
removed AS (SELECT n.row, sum(n.n) AS n FROM normal n JOIN frequent f USING (host, line) GROUP BY n.row),
counted AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(x.n, 0) AS BIGINT) AS removed_words
  FROM words d LEFT JOIN dups u ON d.row = u.row LEFT JOIN repeats r ON d.row = r.row LEFT JOIN removed x ON d.row = x.row),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words - removed_words < CAST(0.25 AS DOUBLE) * n_words AS depleted FROM counted)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""

NEAR_DEDUP = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
   AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared WHERE 100 * i >= 80 * (nx + ny - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM sets
  UNION SELECT reach.doc_id, b.y FROM reach JOIN both_ways b ON reach.r = b.x),
comps AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN comps c ON s.doc_id = c.doc_id
"""

TOPK_SEARCH = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES = {
    "op4_topk_search": TOPK_SEARCH,
    "op8_mixing": MIXING,
    "op9_quality_rules": QUALITY_RULES,
    "op10_near_dedup": NEAR_DEDUP,
}
