"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE))
      / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source),
s1 AS (SELECT *, CASE place WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS ceiling FROM s0),
s2 AS (SELECT *, row_number() OVER w AS row, coalesce(sum(ceiling) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from, sum(source_size) OVER () AS total FROM s1
  WINDOW w AS (ORDER BY CAST(ceiling AS DOUBLE) / weight, place, source NULLS LAST)),
s3 AS (SELECT *, (CAST(total AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(full_before AS DOUBLE)) / CAST(weight_from AS DOUBLE) AS level FROM s2),
f AS (SELECT min(row) AS row, arg_min(level, row) AS level FROM s3 WHERE level * weight < ceiling),
s4 AS (SELECT source, source_size, CASE WHEN f.row IS NULL OR s3.row < f.row THEN CAST(ceiling AS DOUBLE)
    ELSE least(f.level * weight, CAST(ceiling AS DOUBLE)) END AS target FROM s3, f),
t AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM s4),
t2 AS (SELECT *, target - whole * source_size AS rest FROM t),
r AS (SELECT d.*, t2.source_size, t2.target, t2.whole, t2.rest, row_number() OVER w AS nth,
    CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source
  WINDOW w AS (PARTITION BY d.source ORDER BY u, doc_id NULLS FIRST, size)),
r2 AS (SELECT *, rest > 0 AND upto <= rest AS sampled FROM r),
g AS (SELECT source, any_value(rest) - coalesce(max(CASE WHEN sampled THEN upto END), 0) AS gap FROM r2 GROUP BY source),
l AS (SELECT r2.source, arg_min(nth, (abs(gap - size), nth)) AS last FROM r2 JOIN g ON r2.source IS NOT DISTINCT FROM g.source
  WHERE NOT sampled AND size > 0 AND abs(gap - size) < gap GROUP BY r2.source)
SELECT doc_id, size, source_size, target, CAST(size * c AS BIGINT) AS taken, CAST(c AS INTEGER) AS copies, source FROM (
  SELECT r2.*, whole + CASE WHEN sampled OR coalesce(nth = last, false) THEN 1 ELSE 0 END AS c
  FROM r2 LEFT JOIN l ON r2.source IS NOT DISTINCT FROM l.source) x"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10"""
