"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import covertree, minhash, mixing, packing, pii, quality, suffix, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality": quality.op2_quality,
    "op3_covertree": covertree.op3_covertree,
    "op4_warc": warc.op4_warc,
    "op5_suffix": suffix.op5_suffix,
    "op6_topk": topk.op6_topk,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op9_minhash": minhash.op9_minhash,
    "op10_packing": packing.op10_packing,
}

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x,
    label IS NOT NULL AND coalesce(len(embedding), 0) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.ok AND b.ok AND a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.x, b.x) >= 0.98
), r AS (
  SELECT a AS v, b AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a
), c AS (SELECT v, min(w) AS w FROM r GROUP BY v),
n AS (SELECT a AS v, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.w, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.w, vec_id)) AS kept
FROM v LEFT JOIN c ON c.v = vec_id LEFT JOIN n ON n.v = vec_id
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, html, strlen(html) AS payload_bytes,
    list_aggregate(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits
  FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER)
    + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), t AS (SELECT doc_id, unnest(s) AS t FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
  SELECT a AS v, b AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a
), c AS (SELECT v, min(w) AS w FROM r GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.w, n.doc_id)) AS component_id,
  n.doc_id = least(n.doc_id, coalesce(c.w, n.doc_id)) AS kept
FROM n LEFT JOIN c ON c.v = n.doc_id
"""

SQL = {"op3_covertree": OP3_SQL, "op4_warc": OP4_SQL, "op6_topk": topk.OP6_SQL, "op9_minhash": OP9_SQL}
