"""SQL that gives the same rows as some of the queries of this package; the others are tested by brute force."""

P2 = r"""
WITH rows AS (SELECT DISTINCT node_id, chunk_text, symbol FROM chunks),
occurrences AS (
  SELECT node_id, chunk_text, lower(unnest(regexp_extract_all(concat_ws(' ', chunk_text, symbol), '[A-Za-z_][A-Za-z0-9_]+'))) AS term
  FROM rows),
counted AS (SELECT node_id, term, count(*) AS tf, bool_or(coalesce(chunk_text, '') <> '') AS has_text FROM occurrences GROUP BY node_id, term),
statistics AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counted GROUP BY term)
"""

P7 = r"""
WITH texts AS (SELECT DISTINCT node_id, chunk_text FROM chunks WHERE node_id IS NOT NULL),
words AS (SELECT node_id, regexp_extract_all(lower(chunk_text), '[A-Za-z0-9_]+') AS w FROM texts),
runs AS (SELECT node_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM words WHERE len(w) >= 3),
sizes AS (SELECT node_id, count(*) AS n FROM runs GROUP BY node_id),
shared AS (
  SELECT a.node_id AS node_id_a, b.node_id AS node_id_b, count(*) AS both_have FROM runs a JOIN runs b ON a.run = b.run AND a.node_id < b.node_id GROUP BY ALL)
SELECT node_id_a, node_id_b FROM shared JOIN sizes a ON a.node_id = node_id_a JOIN sizes b ON b.node_id = node_id_b
WHERE both_have >= 0.6 * (a.n + b.n - both_have)
"""

ORACLE = {
    "p2_found": P2 + """
SELECT node_id, term FROM counted JOIN statistics USING (term) WHERE has_text AND tf >= 5 AND df <= 3
""",
    "p2_scores": P2 + """,
total AS (SELECT count(DISTINCT node_id)::DOUBLE AS n FROM chunks)
SELECT node_id, term, tf, df, cf::BIGINT AS cf,
  round(tf * greatest(0.0, -log2(df / n) + log2(1 - exp(-cf::DOUBLE / n))), 6) AS score
FROM counted JOIN statistics USING (term) CROSS JOIN total WHERE has_text
""",
    "p7_found": P7,
}
