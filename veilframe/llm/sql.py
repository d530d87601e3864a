"""DuckDB statements that say the same as the queries, over the driver's tables."""

from __future__ import annotations

#: Words with A-Z lower-cased, by document.
WORDS = r"""words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs})"""

NEAR = (
    "WITH RECURSIVE "
    + WORDS.format(docs="documents")
    + """,
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
around AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM around UNION SELECT r.node, x.b FROM reach r JOIN around x ON r.other = x.a),
least AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least ON doc_id = node"""
)

NEAREST = """WITH rows AS (SELECT vec_id AS id, max(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
scored AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM rows q JOIN rows c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""
