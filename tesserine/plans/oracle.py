"""SQL that gives the same rows as the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

from tesserine.operators.symbols import C_FAMILY, GENERIC, PYTHON

ORACLE: dict[str, str] = {}

_TOKEN = "[A-Za-z_][A-Za-z0-9_]{1,}"

_VERSIONS = r"""
versions AS (
  SELECT version, row_number() OVER (ORDER BY min(created_at::TIMESTAMPTZ), version) AS n FROM index_versions WHERE version IS NOT NULL GROUP BY version),
spelled AS (
  SELECT version, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(file_path), '\', '/'), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', ''), '^/|/$', '', 'g') AS file_path,
    nullif(regexp_replace(lower(trim(digest)), '^sha-?1[:=]', ''), '') AS digest, loaded_at
  FROM manifest),
current AS (
  SELECT n, file_path, digest FROM spelled JOIN versions USING (version) WHERE file_path <> ''
  QUALIFY row_number() OVER (PARTITION BY n, file_path ORDER BY loaded_at DESC, digest DESC NULLS LAST) = 1)
"""

_CHANGES = f"""
WITH {_VERSIONS},
islands AS (SELECT *, n - row_number() OVER (PARTITION BY file_path ORDER BY n) AS island FROM current),
known AS (
  SELECT n, file_path, island,
    last_value(digest IGNORE NULLS) OVER (PARTITION BY file_path, island ORDER BY n ROWS UNBOUNDED PRECEDING) AS digest
  FROM islands),
before AS (SELECT *, lag(n) OVER w AS last_n, lag(digest) OVER w AS last_digest, lead(n) OVER w AS next_n FROM known WINDOW w AS (PARTITION BY file_path ORDER BY n)),
changes AS (
  SELECT n, file_path, 'added' AS change_kind FROM before WHERE n > 1 AND coalesce(last_n, 0) <> n - 1
  UNION ALL
  SELECT n + 1, file_path, 'removed' FROM before WHERE n < (SELECT max(n) FROM versions) AND coalesce(next_n, 0) <> n + 1
  UNION ALL
  SELECT n, file_path, 'changed' FROM before WHERE last_n = n - 1 AND digest <> last_digest)
"""

ORACLE["p6_found"] = _CHANGES + """
SELECT version, file_path, change_kind FROM changes JOIN versions USING (n)
"""

ORACLE["p6_changes"] = _CHANGES + """
SELECT version, file_path, change_kind, CASE WHEN change_kind <> 'added' THEN digest END AS old_digest
FROM changes JOIN versions USING (n) LEFT JOIN (SELECT n + 1 AS n, file_path, digest FROM current) USING (n, file_path)
"""

_NODES = f"""
nodes AS (
  SELECT node_id, any_value(module) AS module, any_value(file_path) AS file_path, any_value(symbol) AS symbol, any_value(language) AS language,
    any_value(chunk_text) AS chunk_text, any_value(start_line) AS start_line, any_value(neighbors) AS neighbors
  FROM chunks WHERE node_id IS NOT NULL GROUP BY node_id),
words AS (
  SELECT node_id, module, language, symbol,
    list_transform(regexp_extract_all(concat_ws(' ', module, file_path, symbol, chunk_text), '{_TOKEN}'), lambda x: lower(x)) AS words
  FROM nodes),
occurrences AS (SELECT node_id, unnest(words) AS token FROM words),
postings AS (SELECT node_id, token, count(*) AS tf FROM occurrences GROUP BY ALL),
frequencies AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
sizes AS (SELECT count(*) AS n, coalesce(avg(len(words)), 1.0) AS avg_len FROM words)
"""

_QUERIES = f"""
asked AS (
  SELECT query_id, coalesce(any_value(text), '') AS text, any_value(module_scope) AS module_scope, any_value(language) AS language,
    any_value(symbol_hint) AS symbol_hint, any_value(graph_hops) AS graph_hops,
    list_transform(regexp_extract_all(coalesce(any_value(text), ''), '{_TOKEN}'), lambda x: lower(x)) AS words
  FROM queries WHERE query_id IS NOT NULL GROUP BY query_id),
brought AS (
  SELECT * FROM (VALUES
    ('latency', ['p95', 'throughput', 'qps', 'delay']), ('symbol', ['identifier', 'function', 'method', 'api']),
    ('graph', ['dependency', 'callgraph', 'edge', 'neighbor']), ('index', ['hnsw', 'ivf', 'diskann', 'bitmap']),
    ('consistency', ['transaction', 'outbox', 'atomic', 'sync'])) AS t(word, more)),
expanded AS (
  SELECT query_id, unnest(words) AS token FROM asked
  UNION ALL
  SELECT query_id, unnest(more) FROM (SELECT query_id, unnest(words) AS word FROM asked) JOIN brought USING (word)),
pairs AS (
  SELECT query_id, node_id FROM asked CROSS JOIN nodes
  WHERE (coalesce(module_scope, '') = '' OR coalesce(contains(lower(module), lower(module_scope)), false))
    AND (coalesce(asked.language, '') = '' OR coalesce(lower(nodes.language) = lower(asked.language), false)))
"""


def _top(scored: str, k: int) -> str:
    return f"""(SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank
  FROM ({scored}) QUALIFY rank <= {k})"""


_SLOT = "('0x' || substr(sha1(token), 1, 2))::INT"

_DENSE = f"""
node_slots AS (SELECT node_id, {_SLOT} AS slot, count(*) AS n FROM occurrences GROUP BY ALL),
query_slots AS (SELECT query_id, {_SLOT} AS slot, count(*) AS n FROM expanded GROUP BY ALL),
node_norms AS (SELECT node_id, sqrt(sum(n * n)) AS norm FROM node_slots GROUP BY node_id),
query_norms AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM query_slots GROUP BY query_id),
products AS (SELECT query_id, node_id, sum(q.n * d.n) AS dot FROM query_slots q JOIN node_slots d USING (slot) GROUP BY ALL),
dense_scores AS (
  SELECT query_id, node_id,
    round(round(coalesce(dot / (q.norm * d.norm), 0.0), 9)
      + CASE WHEN coalesce(symbol_hint, '') <> '' AND coalesce(contains(lower(symbol), lower(symbol_hint)), false) THEN 0.05 ELSE 0.0 END, 9) AS score
  FROM pairs JOIN asked USING (query_id) JOIN nodes USING (node_id)
  LEFT JOIN products USING (query_id, node_id) LEFT JOIN query_norms q USING (query_id) LEFT JOIN node_norms d USING (node_id))
"""

_SPARSE = """
query_counts AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(words) AS token FROM asked) GROUP BY ALL),
sparse_scores AS (
  SELECT query_id, node_id, round(sum(times * (ln((n + 1) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg_len))), 9) AS score
  FROM query_counts JOIN postings USING (token) JOIN frequencies USING (token) JOIN words USING (node_id) JOIN pairs USING (query_id, node_id) CROSS JOIN sizes
  GROUP BY ALL HAVING score > 0)
"""

_SYMBOL = """
hints AS (
  SELECT query_id, CASE WHEN lower(trim(coalesce(symbol_hint, ''))) <> '' THEN lower(trim(symbol_hint))
    ELSE coalesce(list_filter(words, lambda w: ends_with(w, 'service') OR ends_with(w, 'index'))[1], '') END AS hint
  FROM asked),
symbol_scores AS (
  SELECT query_id, node_id, CASE WHEN lower(symbol) = hint THEN 1.0 WHEN starts_with(lower(symbol), hint) THEN 0.85 ELSE 0.7 END::DOUBLE AS score
  FROM hints JOIN pairs USING (query_id) JOIN nodes USING (node_id) WHERE hint <> '' AND contains(lower(symbol), hint))
"""

_EDGES = """
forth AS (SELECT node_id AS src, unnest(neighbors) AS dst FROM nodes),
edges AS (SELECT src, dst FROM forth WHERE dst IS NOT NULL UNION SELECT dst, src FROM forth WHERE dst IS NOT NULL)
"""

_GRAPH = f"""
{_EDGES},
seed_names AS (SELECT query_id, node_id FROM {_top("SELECT * FROM symbol_scores", 3)}),
seeds AS (
  SELECT query_id, node_id FROM seed_names
  UNION ALL
  SELECT query_id, node_id FROM {_top("SELECT * FROM dense_scores", 3)} WHERE query_id NOT IN (SELECT query_id FROM seed_names)),
reached AS (
  SELECT query_id, node_id, 0 AS depth FROM seeds
  UNION
  SELECT r.query_id, e.dst, r.depth + 1 FROM reached r JOIN edges e ON e.src = r.node_id JOIN asked a ON a.query_id = r.query_id
  WHERE r.depth < coalesce(a.graph_hops, 2)),
graph_scores AS (
  SELECT query_id, node_id, round(1 / (min(depth) + 1), 9) AS score FROM reached JOIN pairs USING (query_id, node_id) GROUP BY ALL)
"""

_ROUTES = f"""
WITH RECURSIVE {_NODES}, {_QUERIES}, {_DENSE}, {_SPARSE}, {_SYMBOL}, {_GRAPH}
"""


def _fused(k: int) -> str:
    hits = " UNION ALL ".join(
        f"SELECT '{r}' AS route, * FROM {_top(f'SELECT * FROM {r}_scores', k)}" + (" WHERE query_id IN (SELECT query_id FROM named)" if r == "symbol" else "")
        for r in ("dense", "sparse", "symbol", "graph")
    )
    total = " + ".join(f"coalesce(max(CASE WHEN route = '{r}' THEN 1 / (rank + 60) END), 0.0)" for r in ("dense", "sparse", "symbol", "graph"))
    return f"""
named AS (
  SELECT query_id FROM asked WHERE coalesce(symbol_hint, '') <> '' OR contains(lower(text), '::') OR contains(lower(text), '(') OR contains(lower(text), 'service')),
route_hits AS ({hits}),
fused AS {_top(f"SELECT query_id, node_id, round({total}, 9) AS score FROM route_hits GROUP BY ALL", 2 * k)}
"""


def _final(k: int) -> str:
    return f"""{_fused(k)},
reranked AS (
  SELECT f.query_id, f.node_id,
    round(greatest(0.0, 0.6 * f.score
      + 0.35 * (len(list_intersect(list_distinct(a.words), list_distinct(w.words))) / greatest(1.0, len(list_distinct(a.words))))
      + CASE WHEN coalesce(symbol_hint, '') <> '' AND coalesce(contains(lower(symbol), lower(symbol_hint)), false) THEN 0.2 ELSE 0.0 END
      - least(0.2, len(list_distinct(w.words)) / 2000.0)), 9) AS score
  FROM fused f JOIN asked a USING (query_id) JOIN words w USING (node_id)),
final AS {_top("SELECT * FROM reranked", k)}
"""


ORACLE["tokenize"] = f"""
SELECT doc_id, (pos - 1)::INT AS pos, lower(token) AS token FROM (
  SELECT doc_id, unnest(found) AS token, generate_subscripts(found, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(any_value(text), '{_TOKEN}') AS found FROM documents GROUP BY doc_id))
"""
ORACLE["hash_slots"] = f"WITH {_NODES} SELECT node_id, {_SLOT} AS slot, count(*) AS n FROM occurrences GROUP BY ALL"
ORACLE["term_freq"] = f"WITH {_NODES} SELECT node_id, token, tf FROM postings"
ORACLE["doc_freq"] = f"WITH {_NODES} SELECT token, df FROM frequencies"
ORACLE["idf"] = f"WITH {_NODES} SELECT token, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf FROM frequencies CROSS JOIN sizes"
ORACLE["avg_doc_len"] = f"WITH {_NODES} SELECT n AS nodes, round(avg_len, 9) AS avg_len FROM sizes"
ORACLE["query_expansion"] = f"""
WITH {_NODES}, {_QUERIES},
lists AS (
  SELECT query_id, list_concat(words, flatten(list_transform(words, lambda w: CASE w
    WHEN 'latency' THEN ['p95', 'throughput', 'qps', 'delay'] WHEN 'symbol' THEN ['identifier', 'function', 'method', 'api']
    WHEN 'graph' THEN ['dependency', 'callgraph', 'edge', 'neighbor'] WHEN 'index' THEN ['hnsw', 'ivf', 'diskann', 'bitmap']
    WHEN 'consistency' THEN ['transaction', 'outbox', 'atomic', 'sync'] ELSE []::VARCHAR[] END))) AS found FROM asked)
SELECT query_id, (generate_subscripts(found, 1) - 1)::INT AS pos, unnest(found) AS token FROM lists
"""
ORACLE["dense_topk"] = f"WITH {_NODES}, {_QUERIES}, {_DENSE} SELECT * FROM {_top('SELECT * FROM dense_scores', 8)}"
ORACLE["sparse_bm25_topk"] = f"WITH {_NODES}, {_QUERIES}, {_SPARSE} SELECT * FROM {_top('SELECT * FROM sparse_scores', 8)}"
ORACLE["symbol_topk"] = f"WITH {_NODES}, {_QUERIES}, {_SYMBOL} SELECT * FROM {_top('SELECT * FROM symbol_scores', 8)}"
ORACLE["graph_topk"] = f"{_ROUTES} SELECT * FROM {_top('SELECT * FROM graph_scores', 8)}"
ORACLE["rrf_fusion"] = f"{_ROUTES}, {_fused(8)} SELECT * FROM fused"
ORACLE["retrieve"] = f"{_ROUTES}, {_final(8)} SELECT * FROM final"
ORACLE["eval_hit_mrr"] = f"""
{_ROUTES}, {_final(5)},
cases AS (SELECT DISTINCT * FROM eval_cases)
SELECT count(*) AS total, round(coalesce(avg((rank IS NOT NULL)::INT), 0.0), 9) AS hit_at_5, round(coalesce(avg(coalesce(1 / rank, 0.0)), 0.0), 9) AS mrr
FROM cases c LEFT JOIN final f ON f.query_id = c.query_id AND f.node_id = c.expected_node_id
"""
ORACLE["plan_routes"] = f"""
WITH {_NODES}, {_QUERIES},
routed AS (
  SELECT query_id, CASE WHEN coalesce(symbol_hint, '') <> '' OR contains(lower(text), '::') OR contains(lower(text), '(') OR contains(lower(text), 'service')
    THEN ['dense', 'sparse', 'symbol', 'graph'] ELSE ['dense', 'sparse', 'graph'] END AS routes FROM asked)
SELECT query_id, (generate_subscripts(routes, 1) - 1)::INT AS pos, unnest(routes) AS route FROM routed
"""

_FILES = r"""
files AS (SELECT source || '/' || doc_id || '.md' AS file_path, regexp_replace(text, '\r\n?', chr(10), 'g') AS content FROM documents WHERE text IS NOT NULL),
split_lines AS (
  SELECT file_path, CASE WHEN found[len(found)] = '' THEN found[1:len(found) - 1] ELSE found END AS found
  FROM (SELECT file_path, string_split_regex(content, '[\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS found FROM files))
"""


def _policy(n: str, language: str) -> str:
    return f"""
    (CASE WHEN {n} <= 120 THEN {n} ELSE CASE WHEN {language} = 'markdown' THEN 140 ELSE 100 END + CASE WHEN {n} > 1000 THEN 60 WHEN {n} > 500 THEN 30 ELSE 0 END END)::INT AS size,
    (CASE WHEN {n} <= 120 THEN 0 ELSE CASE WHEN {language} = 'markdown' THEN 30 ELSE 25 END + CASE WHEN {n} > 1000 THEN 10 WHEN {n} > 500 THEN 5 ELSE 0 END END)::INT AS overlap"""


_COUNT = "(CASE WHEN n = 0 THEN 0 WHEN n <= size THEN 1 ELSE ceil((n - size) / greatest(size - overlap, 1)) + 1 END)::INT"
ORACLE["chunk_policy"] = f"""
WITH {_FILES},
lengths AS (SELECT DISTINCT len(found)::INT AS n FROM split_lines),
both_kinds AS (SELECT n, unnest(['markdown', 'python']) AS language FROM lengths),
sized AS (SELECT n, language, {_policy('n', 'language')} FROM both_kinds)
SELECT n, language, size, overlap, {_COUNT} AS chunks FROM sized
"""
ORACLE["chunk_lines"] = f"""
WITH {_FILES},
lengths AS (SELECT file_path, found, len(found)::INT AS n, 'markdown' AS language FROM split_lines),
sized AS (SELECT *, {_policy('n', 'language')} FROM lengths),
counted AS (SELECT *, {_COUNT} AS chunks FROM sized),
numbered AS (SELECT *, unnest(range(chunks)) AS i FROM counted),
placed AS (SELECT *, (i * (size - overlap) + 1)::INT AS start_line, least(n, i * (size - overlap) + size)::INT AS end_line FROM numbered),
texts AS (SELECT *, array_to_string(found[start_line:end_line], chr(10)) AS chunk_text FROM placed)
SELECT substr(sha1(file_path || ':' || start_line || ':' || end_line || ':' || substr(chunk_text, 1, 512)), 1, 16) AS node_id,
  split_part(file_path, '/', 1) AS module, file_path, language, start_line, end_line, i::VARCHAR AS chunk_index, sha1(chunk_text) AS text_sha1
FROM texts
"""
ORACLE["paths"] = f"""
WITH {_VERSIONS},
distinct_paths AS (SELECT DISTINCT file_path FROM spelled WHERE file_path IS NOT NULL)
SELECT file_path,
  CASE WHEN contains(file_path, '.') THEN CASE lower(list_last(string_split(file_path, '.')))
    WHEN 'py' THEN 'python' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'h' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'c' THEN 'c' WHEN 'java' THEN 'java'
    WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'md' THEN 'markdown' END END AS language,
  CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'root' END AS module,
  regexp_replace(list_last(string_split(file_path, '/')), '^(.+)\\.[^.]*$', '\\1') AS stem
FROM distinct_paths
""".replace("\\\\", "\\")
ORACLE["symbols_python"] = rf"""
WITH {_NODES},
names AS (
  SELECT node_id, unnest(regexp_extract_all(chunk_text, '(?m)^\s*(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name
  FROM nodes WHERE lower(language) = 'python')
SELECT node_id, name, count(*) AS n FROM names GROUP BY ALL
"""
_LOCAL = """
local_edges AS (
  SELECT node_id, unnest([lag(node_id) OVER w, lead(node_id) OVER w]) AS neighbor FROM nodes WHERE file_path IS NOT NULL
  WINDOW w AS (PARTITION BY file_path ORDER BY start_line, node_id))
"""
_IMPORTS = r"""
imports AS (
  SELECT node_id, unnest(regexp_extract_all(chunk_text, '(?m)^\s*#include\s+["<]([^">]+)[">]', 1)) AS target, true AS is_path FROM nodes
  UNION ALL
  SELECT node_id, unnest(list_transform(regexp_extract_all(chunk_text, '(?m)^\s*(?:from\s+[A-Za-z0-9_\.]+\s+import|import\s+[A-Za-z0-9_\.]+)'),
    lambda x: regexp_extract(x, '^\s*(?:from|import)\s+([A-Za-z0-9_\.]+)', 1))), false FROM nodes),
stems AS (
  SELECT DISTINCT node_id, CASE WHEN is_path THEN regexp_replace(list_last(string_split(target, '/')), '^(.+)\.[^.]*$', '\1')
    ELSE list_last(string_split(target, '.')) END AS stem FROM imports),
firsts AS (SELECT file_path, arg_min(node_id, (start_line, node_id)) AS neighbor FROM nodes WHERE file_path IS NOT NULL GROUP BY file_path),
import_edges AS (
  SELECT DISTINCT node_id, neighbor FROM stems
  JOIN (SELECT regexp_replace(list_last(string_split(file_path, '/')), '^(.+)\.[^.]*$', '\1') AS stem, neighbor FROM firsts) USING (stem))
"""
_REFERENCES = """
named_firsts AS (SELECT lower(symbol) AS token, arg_min(node_id, (file_path, start_line, node_id)) AS neighbor FROM nodes WHERE symbol IS NOT NULL GROUP BY ALL),
mentions AS (SELECT DISTINCT node_id, lower(symbol) AS own, lower(unnest(regexp_extract_all(chunk_text, '[A-Za-z_][A-Za-z0-9_]{2,}'))) AS token FROM nodes),
reference_edges AS (SELECT DISTINCT node_id, neighbor FROM mentions JOIN named_firsts USING (token) WHERE own IS NULL OR token <> own)
"""
ORACLE["edges_locality"] = f"WITH {_NODES}, {_LOCAL} SELECT node_id, neighbor FROM local_edges WHERE neighbor IS NOT NULL"
ORACLE["edges_import"] = f"WITH {_NODES}, {_IMPORTS} SELECT node_id, neighbor FROM import_edges"
ORACLE["edges_symbol_ref"] = f"WITH {_NODES}, {_REFERENCES} SELECT node_id, neighbor FROM reference_edges"
ORACLE["neighbours_final"] = f"""
WITH {_NODES}, {_LOCAL}, {_IMPORTS}, {_REFERENCES},
every AS (
  SELECT node_id, neighbor FROM local_edges WHERE neighbor IS NOT NULL UNION SELECT node_id, neighbor FROM import_edges UNION SELECT node_id, neighbor FROM reference_edges)
SELECT node_id, (row_number() OVER (PARTITION BY node_id ORDER BY neighbor) - 1)::INT AS pos, neighbor FROM every WHERE node_id <> neighbor
"""
ORACLE["graph_symmetric"] = f"WITH {_NODES}, {_EDGES} SELECT src, dst FROM edges"

_KNN = """
asked AS (SELECT vec_id AS qid, embedding AS query FROM embeddings WHERE vec_id % 50 = 0),
measured AS (
  SELECT qid, vec_id AS id, embedding, query,
    sqrt(list_sum(list_transform(list_zip(embedding, query), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance
  FROM asked CROSS JOIN embeddings {where}),
nearest AS (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank FROM measured QUALIFY rank <= 10)
"""
_CODEC = """
dims AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
codec AS (
  SELECT i::INT AS i, min(x) AS low, (63::DOUBLE / greatest((max(x) - min(x))::FLOAT, 1e-6::FLOAT)::DOUBLE)::FLOAT AS scale FROM dims GROUP BY i),
coded AS (
  SELECT id, i, x, low, scale,
    floor(greatest(0.0, least(63.0, ((((x - low)::FLOAT) * scale)::FLOAT)::DOUBLE)) + 0.5)::INT AS code
  FROM dims JOIN codec USING (i)),
decoded AS (SELECT *, (((code::FLOAT / scale)::FLOAT) + low)::FLOAT AS y FROM coded)
"""
ORACLE["knn_exact"] = f"WITH {_KNN.format(where='')} SELECT qid, id, round(distance, 6) AS distance, rank FROM nearest"
ORACLE["knn_filtered"] = f"WITH {_KNN.format(where='WHERE vec_id % 11 <> 0')} SELECT qid, id, round(distance, 6) AS distance, rank FROM nearest"
_QUANTISED = f"""
{_CODEC},
given_back AS (SELECT id, list(y ORDER BY i) AS vector FROM decoded GROUP BY id),
coarse AS (
  SELECT qid, id, distance,
    sqrt(list_sum(list_transform(list_zip(vector, query), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS rough
  FROM measured JOIN given_back USING (id)),
kept AS (SELECT qid, id, distance FROM coarse QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rough, id) <= 64),
reranked AS (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank FROM kept QUALIFY rank <= 10)
"""
ORACLE["knn_quantised_rerank"] = f"WITH {_KNN.format(where='')}, {_QUANTISED} SELECT qid, id, round(distance, 6) AS distance, rank FROM reranked"
ORACLE["recall_at_k"] = f"""
WITH {_KNN.format(where='')}, {_QUANTISED}
SELECT count(*) AS queries, round(avg(n / 10), 9) AS recall FROM (
  SELECT e.qid, count(r.id) AS n FROM nearest e LEFT JOIN reranked r ON r.qid = e.qid AND r.id = e.id GROUP BY e.qid)
"""
ORACLE["codec_fit"] = f"WITH {_CODEC} SELECT i, round(low::DOUBLE, 6) AS low, round(scale::DOUBLE, 3) AS scale FROM codec"
ORACLE["codec_encode"] = f"WITH {_CODEC} SELECT id, i::INT AS i, code FROM coded"
ORACLE["codec_decode_error"] = f"WITH {_CODEC} SELECT i::INT AS i, max(abs(x - y) * scale) <= 0.5001 AS within_half_step, count(*) AS n FROM decoded GROUP BY i"
ORACLE["project_identity"] = f"WITH {_CODEC} SELECT id, i::INT AS i, round(x::DOUBLE, 6) AS x FROM dims"
ORACLE["project_rotation"] = """
SELECT vec_id AS id, i::INT AS i, round(CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END * embedding[xor(i, 1) + 1]::DOUBLE, 6) AS x
FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)
"""
ORACLE["block_assign"] = "SELECT vec_id AS id, (vec_id // 64)::BIGINT AS block_id FROM embeddings"
ORACLE["io_order"] = """
WITH placed AS (SELECT vec_id AS id, vec_id // 64 AS block_id, row_number() OVER (ORDER BY vec_id // 64, vec_id) - 1 AS pos FROM embeddings)
SELECT id, block_id::BIGINT AS block_id, pos::BIGINT AS pos, (pos // 16)::BIGINT AS batch FROM placed
"""
ORACLE["io_merged_ops"] = """
SELECT count_if(gap IS NULL OR gap > 1)::BIGINT AS ops FROM (
  SELECT block_id - lag(block_id) OVER (ORDER BY block_id) AS gap FROM (SELECT DISTINCT entry_id // 4 AS block_id FROM search_requests WHERE entry_id >= 0))
"""
ORACLE["percentile_floor_index"] = """
WITH sorted AS (
  SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS pos, count(*) OVER (PARTITION BY l_returnflag) AS n
  FROM lineitem WHERE l_quantity IS NOT NULL)
SELECT l_returnflag, n, l_quantity AS percentile FROM sorted WHERE pos = floor((n - 1) * 0.95)
"""
_GRAPH_NODES = """
nodes AS (SELECT id, any_value(neighbors) AS neighbors FROM graph_nodes WHERE id IS NOT NULL GROUP BY id),
requests AS (SELECT request_id, any_value(entry_id) AS entry_id FROM search_requests WHERE request_id IS NOT NULL GROUP BY request_id),
listed AS (SELECT id AS src, unnest(neighbors) AS dst FROM nodes),
directed AS (SELECT src, dst FROM listed WHERE dst IN (SELECT id FROM nodes)),
edges AS (SELECT src, dst FROM directed UNION SELECT dst, src FROM directed)
"""
ORACLE["bfs_khop"] = f"""
WITH RECURSIVE {_GRAPH_NODES},
reached AS (
  SELECT request_id, entry_id AS id, 0 AS depth FROM requests WHERE entry_id IS NOT NULL
  UNION
  SELECT r.request_id, e.dst, r.depth + 1 FROM reached r JOIN edges e ON e.src = r.id WHERE r.depth < 2)
SELECT request_id, id, min(depth)::INT AS depth FROM reached GROUP BY ALL
"""
_LOG = """
log AS (
  SELECT user_id AS node_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, [user_id // 2, user_id + 1, event_id % 50] AS neighbors
  FROM events WHERE user_id IS NOT NULL),
newest AS (SELECT node_id, max(version) AS version, arg_max(neighbors, version) AS neighbors FROM log GROUP BY node_id)
"""
ORACLE["occ_latest"] = f"WITH {_LOG} SELECT node_id, version, array_to_string(neighbors, ',') AS neighbors FROM newest"
ORACLE["occ_validate"] = f"WITH {_LOG} SELECT node_id, version, node_id % 3 <> 0 AS valid FROM newest"
_DIFF = f"""
{_VERSIONS},
last_two AS (SELECT version, row_number() OVER (ORDER BY n DESC) AS back, n FROM versions QUALIFY back <= 2),
new_rows AS (SELECT file_path, digest FROM current WHERE n = (SELECT n FROM last_two WHERE back = 1)),
old_rows AS (SELECT file_path, digest FROM current WHERE n = (SELECT n FROM last_two WHERE back = 2)),
diff AS (
  SELECT file_path, 'deleted' AS status FROM old_rows WHERE file_path NOT IN (SELECT file_path FROM new_rows)
  UNION ALL
  SELECT w.file_path, 'changed' FROM new_rows w LEFT JOIN old_rows o ON o.file_path = w.file_path
  WHERE o.file_path IS NULL OR w.digest IS NOT NULL AND w.digest IS DISTINCT FROM o.digest)
"""
ORACLE["manifest_diff"] = f"WITH {_DIFF} SELECT file_path, status FROM diff"
ORACLE["incremental_merge"] = f"""
WITH {_DIFF}, {_NODES}
SELECT node_id, file_path FROM nodes WHERE file_path NOT IN (SELECT file_path FROM diff WHERE status = 'deleted')
"""
ORACLE["snapshot_roundtrip"] = f"WITH {_NODES} SELECT node_id, file_path, sha1(coalesce(chunk_text, '')) AS text_sha1 FROM nodes"


_BFS = """
listed AS (
  SELECT src, ordinal, dst FROM (SELECT id AS src, unnest(neighbors) AS dst, generate_subscripts(neighbors, 1) AS ordinal FROM net)
  WHERE dst IN (SELECT id FROM net)),
steps AS (
  SELECT request_id, budget, [entry_id] AS visited, [entry_id] AS frontier FROM asked WHERE budget > 0 AND entry_id IN (SELECT id FROM net)
  UNION ALL
  SELECT request_id, budget, visited || fresh, fresh
  FROM (
    SELECT s.request_id, s.budget, s.visited, list_slice(list(n.dst ORDER BY n.at, n.ordinal), 1, s.budget - len(s.visited)) AS fresh
    FROM steps s JOIN (
      SELECT f.request_id, l.dst, min(f.at) AS at, min_by(l.ordinal, (f.at, l.ordinal)) AS ordinal
      FROM (SELECT request_id, visited, unnest(frontier) AS src, generate_subscripts(frontier, 1) AS at FROM steps) f JOIN listed l USING (src)
      WHERE NOT list_contains(f.visited, l.dst)
      GROUP BY f.request_id, l.dst) n USING (request_id)
    GROUP BY s.request_id, s.budget, s.visited)
  WHERE len(fresh) > 0),
orders AS (SELECT request_id, arg_max(visited, len(visited)) AS visited FROM steps GROUP BY request_id),
visits AS (SELECT request_id, unnest(visited) AS id, generate_subscripts(visited, 1) - 1 AS pos FROM orders)
"""

_SEARCH = f"""
WITH RECURSIVE net AS (SELECT id, any_value(neighbors) AS neighbors, any_value(embedding) AS embedding FROM graph_nodes WHERE id IS NOT NULL GROUP BY id),
requests AS (
  SELECT request_id, any_value(entry_id) AS entry_id, any_value(max_visit) AS budget, any_value(query) AS query, any_value(top_k) AS top_k
  FROM search_requests WHERE request_id IS NOT NULL GROUP BY request_id),
asked AS (SELECT request_id, entry_id, budget FROM requests),
{_BFS}
"""

ORACLE["bfs_budget_visit_order"] = _SEARCH + "SELECT request_id, pos, id FROM visits"

ORACLE["search_stats"] = _SEARCH + "SELECT request_id, count(*) AS visited, count(*) FILTER (id % 11 = 0) AS filtered_nodes FROM visits GROUP BY request_id"

ORACLE["graph_search_topk"] = _SEARCH + """,
measured AS (
  SELECT request_id, id, pos, top_k,
    CASE WHEN len(query) = len(embedding) THEN sqrt(list_reduce(
      list_transform(list_zip(query, embedding), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::FLOAT), lambda total, x: (total + x)::FLOAT))::FLOAT::DOUBLE
    ELSE 3.4028234663852886e38 END AS distance
  FROM visits JOIN net USING (id) JOIN requests USING (request_id)
  WHERE id % 11 <> 0 AND query IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)
SELECT request_id, id, round(distance, 4) AS distance, rank
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, pos) AS rank FROM measured) WHERE rank <= top_k
"""

ORACLE["occ_traverse"] = f"""
WITH RECURSIVE log AS (
  SELECT user_id AS node_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
    [floor(user_id / 2)::BIGINT, user_id + 1, event_id % 50] AS neighbors
  FROM events WHERE user_id IS NOT NULL),
net AS (SELECT node_id AS id, arg_max(neighbors, version) AS neighbors FROM log GROUP BY node_id),
asked AS (SELECT DISTINCT node_id AS request_id, node_id AS entry_id, 20 AS budget FROM log WHERE node_id % 50 = 0),
{_BFS}
SELECT request_id, pos, id FROM visits
"""

# A mark before each match; what stands before it tells its line.
_SYMBOLS = "\nUNION ALL\n".join(
    f"""SELECT file, unnest(regexp_extract_all(content, '{p}', 1)) AS name, generate_subscripts(regexp_extract_all(content, '{p}', 1), 1) - 1 AS ordinal,
  string_split(regexp_replace(content, '{p}', chr(1) || '\\0', 'g'), chr(1)) AS parts FROM files WHERE {where}"""
    for p, where in (
        ("(?m)" + PYTHON, "language = 'python'"),
        ("(?m)" + C_FAMILY, "language IN ('cpp', 'c', 'java', 'go', 'rust')"),
        (GENERIC, "coalesce(language, '') NOT IN ('python', 'cpp', 'c', 'java', 'go', 'rust')"),
    )
)
_LINES = f"""
matches AS ({_SYMBOLS}),
names AS (
  SELECT file, ordinal, name, 1 + len(array_to_string(parts[1:ordinal + 1], '')) - len(replace(array_to_string(parts[1:ordinal + 1], ''), chr(10), '')) AS line
  FROM matches)
"""

ORACLE["symbols_all"] = f"""
WITH files AS (SELECT node_id AS file, lower(any_value(language)) AS language, any_value(chunk_text) AS content FROM chunks WHERE node_id IS NOT NULL GROUP BY node_id),
{_LINES}
SELECT file AS node_id, ordinal::INT AS ordinal, name, line::INT AS line FROM names
"""

_DOCUMENT_FILES = """
SELECT source || '/' || doc_id || ['.py', '.cpp', '.ts', '.md'][doc_id % 4 + 1] AS file, coalesce(lang, '') AS lang,
  ['python', 'cpp', 'typescript', 'markdown'][doc_id % 4 + 1] AS language, text AS content FROM documents WHERE text IS NOT NULL
"""
_CHUNKED = rf"""
{_LINES},
split AS (SELECT file, language, regexp_split_to_array(regexp_replace(content, '\r\n?', chr(10), 'g'), '[\n\x{{0b}}\x{{0c}}\x{{1c}}\x{{1d}}\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') AS pieces FROM files),
counted AS (SELECT file, language, len(pieces) - (pieces[-1] = '')::INT AS n FROM split),
policy AS (
  SELECT file, n,
    CASE WHEN n <= 120 THEN n ELSE (CASE language WHEN 'markdown' THEN 140 ELSE 100 END) + CASE WHEN n > 1000 THEN 60 WHEN n > 500 THEN 30 ELSE 0 END END AS size,
    CASE WHEN n <= 120 THEN 0 ELSE (CASE language WHEN 'markdown' THEN 30 ELSE 25 END) + CASE WHEN n > 1000 THEN 10 WHEN n > 500 THEN 5 ELSE 0 END END AS lap
  FROM counted WHERE n > 0),
cut AS (
  SELECT file, i * (size - lap) + 1 AS start_line, least(n, i * (size - lap) + size) AS end_line
  FROM (SELECT *, unnest(range(CASE WHEN n <= size THEN 1 ELSE ceil((n - size) / (size - lap))::BIGINT + 1 END)) AS i FROM policy)),
ranked AS (
  SELECT c.*, name, row_number() OVER (
    PARTITION BY c.file, start_line ORDER BY (line BETWEEN start_line AND end_line) DESC,
      CASE WHEN line BETWEEN start_line AND end_line THEN 0 ELSE least(abs(line - start_line), abs(line - end_line)) END, ordinal) AS r
  FROM cut c LEFT JOIN names USING (file))
"""
_LATER = """
later AS (
  SELECT file, language, CASE lang WHEN 'fr' THEN content || chr(10) || 'def changed_later(x):' || chr(10) ELSE content END AS content FROM whole WHERE lang <> 'de'
  UNION ALL
  SELECT 'copies/' || file, language, content FROM whole WHERE lang = 'es')
"""

ORACLE["best_symbol"] = f"""
WITH files AS ({_DOCUMENT_FILES}),
{_CHUNKED}
SELECT file AS file_path, start_line::INT AS start_line, end_line::INT AS end_line, coalesce(name, 'global_scope') AS symbol FROM ranked WHERE r = 1
"""

ORACLE["index_rebuilt"] = f"""
WITH whole AS ({_DOCUMENT_FILES}), {_LATER}, files AS (SELECT * FROM later),
{_CHUNKED}
SELECT file AS file_path, start_line::INT AS start_line, end_line::INT AS end_line, coalesce(name, 'global_scope') AS symbol FROM ranked WHERE r = 1
"""

ORACLE["index_counters"] = f"""
WITH whole AS ({_DOCUMENT_FILES}), {_LATER},
first AS (SELECT * FROM whole),
files AS (SELECT 'v1' || file AS file, language, content FROM first UNION ALL SELECT 'v2' || file, language, content FROM later),
{_CHUNKED},
nodes AS (SELECT file[:2] AS version, count(*) AS nodes FROM ranked WHERE r = 1 GROUP BY 1),
diff AS (SELECT count(*) AS n FROM first FULL JOIN later USING (file) WHERE first.content IS NULL OR later.content IS NULL OR first.content <> later.content)
SELECT version, CASE version WHEN 'v1' THEN (SELECT count(*) FROM first) ELSE (SELECT n FROM diff) END AS changed, nodes FROM nodes
"""

ORACLE["occ_traverse_skips"] = f"""
WITH RECURSIVE log AS (
  SELECT user_id AS node_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
    [floor(user_id / 2)::BIGINT, user_id + 1, event_id % 50] AS neighbors
  FROM events WHERE user_id IS NOT NULL),
net AS (SELECT node_id AS id, arg_max(neighbors, version) AS neighbors FROM log WHERE node_id % 3 <> 0 GROUP BY node_id),
asked AS (SELECT DISTINCT node_id AS request_id, node_id AS entry_id, 20 AS budget FROM log WHERE node_id % 50 = 1),
{_BFS}
SELECT request_id, pos, id FROM visits
"""

_ROOT = str(Path(__file__).resolve().parent.parent)

ORACLE["scan_manifest"] = f"""
SELECT filename[{len(_ROOT) + 2}:] AS file_path, sha1(content) AS digest FROM read_blob('{_ROOT}/**/*.py')
"""

ORACLE["speed_ratio"] = """
WITH ordered AS (
  SELECT l_returnflag, list_sort(list(l_extendedprice)) AS p, list_sort(list(l_discount)) AS d
  FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(coalesce(p[floor((len(p) - 1) * 0.95)::BIGINT + 1] / nullif(d[floor((len(d) - 1) * 0.95)::BIGINT + 1], 0), 0), 6) AS ratio FROM ordered
"""
