"""The queries of the core operators, by name. Every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as text_columns
from tesserine.functions.vector import decoded, encoded
from tesserine.operators import chunking, evaluation, graph, retrieval, snapshots, symbols, vectors
from tesserine.plans import manager
from tesserine.session import write_table
from tesserine.sources import repository, store
from tesserine.sources.tables import table

FLAGSHIP = "retrieve"
#: Hits of a query; neighbours of a vector; bits of a code; vectors reranked.
TOP_K, NEAREST, BITS, RERANK = 8, 10, 6, 64


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.distinct_nodes(table(spark, folder, "chunks"))


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.distinct_queries(table(spark, folder, "queries"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return _vectors(spark, folder).filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))


def _graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_nodes").filter("id IS NOT NULL").dropDuplicates(["id"])


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_requests").filter("request_id IS NOT NULL").dropDuplicates(["request_id"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as markdown files."""
    rows = table(spark, folder, "documents").filter("text IS NOT NULL")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return rows.select(path.alias("file_path"), F.col("text").alias("content"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files added, removed or changed between consecutive versions."""
    return p6_changes(spark, folder).select("version", "file_path", "change_kind")


def p6_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the digest that the version before lists."""
    return snapshots.manifest_changes(table(spark, folder, "manifest"), table(spark, folder, "index_versions"))


# Text and postings


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    rows = table(spark, folder, "documents").dropDuplicates(["doc_id"])
    return rows.select("doc_id", F.posexplode(text_columns.tokens(F.col("text"))).alias("pos", "token"))


def query_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """The words of every query with what they bring along."""
    return _queries(spark, folder).select("query_id", F.posexplode(text_columns.expand(text_columns.tokens(F.col("text")))).alias("pos", "token"))


def hash_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Each node's counts by slot."""
    words = retrieval.node_tokens(_nodes(spark, folder)).select("node_id", F.explode("words").alias("token"))
    return words.groupBy("node_id", text_columns.hash_slot(F.col("token")).alias("slot")).agg(F.count("*").alias("n"))


def term_freq(spark: SparkSession, folder: str) -> DataFrame:
    """A1: how often each token stands in each node."""
    return retrieval.postings(_nodes(spark, folder)).select("node_id", "token", "tf")


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    """A2: in how many nodes each token stands."""
    return retrieval.document_frequencies(retrieval.postings(_nodes(spark, folder)))


def idf(spark: SparkSession, folder: str) -> DataFrame:
    """Each token's inverse document frequency."""
    nodes = _nodes(spark, folder)
    n = F.lit(nodes.count())
    found = retrieval.document_frequencies(retrieval.postings(nodes))
    return found.select("token", F.round(retrieval.idf(F.col("df"), n), 9).alias("idf"))


def avg_doc_len(spark: SparkSession, folder: str) -> DataFrame:
    """The mean length of the nodes."""
    return retrieval.average_length(_nodes(spark, folder)).select("nodes", F.round("avg_len", 9).alias("avg_len"))


# Routes, fusion, reranking


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "node_id", "score", "rank")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Q1: the dense route."""
    return _hits(retrieval.dense(_counted(spark, folder), _queries(spark, folder), TOP_K))


def sparse_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Q2: the sparse route."""
    return _hits(retrieval.sparse(_counted(spark, folder), _queries(spark, folder), TOP_K))


def symbol_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Q3: the symbol route."""
    return _hits(retrieval.symbol(_nodes(spark, folder), _queries(spark, folder), TOP_K))


def graph_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Q4, G1: the graph route."""
    return _hits(retrieval.graph(_counted(spark, folder), _queries(spark, folder), TOP_K))


def plan_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Q5: the routes of each query."""
    return retrieval.plan(_queries(spark, folder)).select("query_id", F.posexplode("routes").alias("pos", "route"))


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """Each node once with its counted words, written, as every route reads them."""
    return retrieval.counted_words(table(spark, folder, "chunks"))


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Q6, Q7: all planned routes fused by rank."""
    return _hits(retrieval.fuse(retrieval.route_hits(_counted(spark, folder), _queries(spark, folder), TOP_K), 2 * TOP_K))


def retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """Q8, Q9: the final hits of every query."""
    return _hits(retrieval.retrieve(_counted(spark, folder), _queries(spark, folder), TOP_K)["final_hits"])


def eval_hit_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """How the final hits answer the cases."""
    found = retrieval.retrieve(_counted(spark, folder), _queries(spark, folder), 5)["final_hits"]
    return retrieval.evaluate(table(spark, folder, "eval_cases"), found)


# Chunks, symbols, edges


def chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, cut into chunks."""
    chunks = chunking.chunk_files(_files(spark, folder))
    return chunks.select("node_id", "module", "file_path", "language", "start_line", "end_line", F.col("metadata")["chunk_index"].alias("chunk_index"), F.sha1("chunk_text").alias("text_sha1"))


def chunk_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and overlaps for files of every length that occurs, as markdown and as code."""
    n = F.size(text_columns.lines(F.regexp_replace("content", "\r\n?", "\n")))
    lengths = _files(spark, folder).select(n.alias("n")).distinct()
    both = lengths.select("n", F.explode(F.array(F.lit("markdown"), F.lit("python"))).alias("language"))
    size, overlap = chunking.chunk_policy(F.col("n"), F.col("language"))
    counted = both.withColumns({"size": size, "overlap": overlap})
    return counted.withColumn("chunks", chunking.chunk_count(F.col("n"), F.col("size"), F.col("overlap")))


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Language, module and stem of every path."""
    rows = table(spark, folder, "manifest").filter("file_path IS NOT NULL").select(text_columns.normal_path(F.col("file_path")).alias("file_path")).distinct()
    path = F.col("file_path")
    return rows.select("file_path", text_columns.language_of(path).alias("language"), text_columns.module_of(path).alias("module"), text_columns.stem(path).alias("stem"))


def _chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as files of their own, whose paths end in the chunk's id."""
    rows = _nodes(spark, folder).filter("chunk_text IS NOT NULL")
    return rows.select(F.col("node_id").alias("file_path"), F.lower("language").alias("language"), F.col("chunk_text").alias("content"))


def symbols_python(spark: SparkSession, folder: str) -> DataFrame:
    """Names that Python chunks define, with their number."""
    found = symbols.file_symbols(_chunk_files(spark, folder).filter("language = 'python'"))
    return found.groupBy(F.col("file_path").alias("node_id"), "name").agg(F.count("*").alias("n"))


def symbols_all(spark: SparkSession, folder: str) -> DataFrame:
    """Names of all languages with their lines."""
    found = symbols.file_symbols(_chunk_files(spark, folder))
    return found.select(F.col("file_path").alias("node_id"), "ordinal", "name", "line")


def _code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of several languages."""
    suffixes = F.array(*map(F.lit, (".py", ".cpp", ".ts", ".md")))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.element_at(suffixes, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    return table(spark, folder, "documents").filter("text IS NOT NULL").select(path.alias("file_path"), F.col("text").alias("content"), "lang")


def best_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """The name that suits each chunk of a file, inside its lines or nearest to them."""
    files = _code_files(spark, folder)
    found = symbols.file_symbols(files.withColumn("language", text_columns.language_of(F.col("file_path"))))
    return symbols.best_symbols(chunking.chunk_files(files), found).select("file_path", "start_line", "end_line", "symbol")


def edges_locality(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks before and after."""
    return symbols.locality_edges(_nodes(spark, folder))


def edges_import(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that import a file, and its first chunk."""
    return symbols.import_edges(_nodes(spark, folder))


def edges_symbol_ref(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that mention a symbol, and its first chunk."""
    return symbols.reference_edges(_nodes(spark, folder))


def neighbours_final(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's neighbours, one row each with its place."""
    found = symbols.neighbours(_nodes(spark, folder))
    return found.select("node_id", F.posexplode("neighbors").alias("pos", "neighbor"))


def graph_symmetric(spark: SparkSession, folder: str) -> DataFrame:
    """The stored neighbour lists as edges both ways."""
    return retrieval.undirected(_nodes(spark, folder))


# Vectors


def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors of each query."""
    found = vectors.exact_nearest(_vectors(spark, folder), _vector_queries(spark, folder), NEAREST)
    return found.withColumn("distance", F.round("distance", 6))


def knn_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """the same among the vectors that a bitmap lets through; it names some ids with 1, and those divisible by 11 with 0."""
    rows = _vectors(spark, folder)
    bitmap = rows.filter("id % 11 = 0 OR id % 3 = 0").select("id", F.when(F.col("id") % 11 == 0, 0).otherwise(1).alias("pass"))
    found = vectors.exact_nearest(graph.passing(rows, bitmap), _vector_queries(spark, folder), NEAREST)
    return found.withColumn("distance", F.round("distance", 6))


def knn_quantised_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse distances to decoded vectors, then exact ones."""
    found = vectors.quantised_nearest(_vectors(spark, folder), _vector_queries(spark, folder), NEAREST, RERANK, BITS)
    return found.withColumn("distance", F.round("distance", 6))


def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """What the quantised search finds of the exact answer."""
    rows, asked = _vectors(spark, folder), _vector_queries(spark, folder)
    return vectors.recall(vectors.exact_nearest(rows, asked, NEAREST), vectors.quantised_nearest(rows, asked, NEAREST, RERANK, BITS), NEAREST)


def codec_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Least value and scale of each dimension."""
    found = vectors.fit_codec(_vectors(spark, folder), BITS)
    return found.select("i", F.round(F.col("low").cast("double"), 6).alias("low"), F.round(F.col("scale").cast("double"), 3).alias("scale"))


def _coded(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    low, scale = vectors.codec_arrays(vectors.fit_codec(rows, BITS))
    lows, scales = (F.array(*[F.lit(float(x)).cast("float") for x in xs]) for xs in (low, scale))
    return rows.withColumn("code", encoded(F.col("vector"), lows, scales, 2**BITS - 1)).withColumn("decoded", decoded(F.col("code"), lows, scales)).withColumn("scale", scales)


def codec_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's codes."""
    return _coded(spark, folder).select("id", F.posexplode("code").alias("i", "code")).withColumn("code", F.col("code").cast("int"))


def codec_decode_error(spark: SparkSession, folder: str) -> DataFrame:
    """V4: whether each dimension's error stays within half a step."""
    rows = _coded(spark, folder).select(F.posexplode(F.arrays_zip("vector", "decoded", "scale")).alias("i", "z"))
    error = F.abs(F.col("z.vector") - F.col("z.decoded"))
    return rows.groupBy("i").agg((F.max(error * F.col("z.scale")) <= 0.5001).alias("within_half_step"), F.count("*").alias("n"))


def project_identity(spark: SparkSession, folder: str) -> DataFrame:
    """V1: vectors as they are."""
    return vectors.projected(_vectors(spark, folder)).select("id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def project_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors times a matrix that swaps each pair of dimensions and turns one's sign."""
    size = 64
    matrix = [[(1.0 if i % 2 else -1.0) if j == (i ^ 1) else 0.0 for j in range(size)] for i in range(size)]
    turned = vectors.projected(_vectors(spark, folder), matrix)
    return turned.select("id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def block_assign(spark: SparkSession, folder: str) -> DataFrame:
    """The block of each vector."""
    return vectors.block_ids(_vectors(spark, folder))


def io_order(spark: SparkSession, folder: str) -> DataFrame:
    """Reads in the order of blocks, in batches of 16."""
    return vectors.read_order(vectors.block_ids(_vectors(spark, folder)))


def io_merged_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of blocks that reading the entries of all requests takes."""
    rows = table(spark, folder, "search_requests").filter("entry_id >= 0").select(F.col("entry_id").alias("id"))
    return vectors.merged_reads(vectors.block_ids(rows, 4))


def percentile_floor_index(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile of quantities by return flag, without interpolation."""
    return evaluation.percentiles(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity", 0.95)


# Graph


def bfs_budget_visit_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order in which every request visits the graph."""
    return graph.visit_order(_graph_nodes(spark, folder).select("id", "neighbors"), _requests(spark, folder))


def graph_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Of the visited nodes that pass the bitmap, the nearest ones."""
    nodes, requests = _graph_nodes(spark, folder), _requests(spark, folder)
    visited = graph.visit_order(nodes.select("id", "neighbors"), requests)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    found = graph.search(visited, nodes.filter(~bad), requests, F.col("id") % 11 != 0)
    return found.withColumn("distance", F.round("distance", 4))


def search_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A10: how many nodes every request visited, and how many of them fail the bitmap."""
    visited = graph.visit_order(_graph_nodes(spark, folder).select("id", "neighbors"), _requests(spark, folder))
    return graph.search_stats(visited, F.col("id") % 11 != 0)


def bfs_khop(spark: SparkSession, folder: str) -> DataFrame:
    """G1: nodes within two hops of each request's entry, neighbour lists read both ways."""
    edges = graph.neighbour_lists(_graph_nodes(spark, folder)).select("src", "dst")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    starts = _requests(spark, folder).filter("entry_id IS NOT NULL").select(F.col("request_id").alias("query_id"), F.col("entry_id").alias("node_id"))
    found = retrieval.within_hops(both, starts, F.lit(2), 2)
    return found.select(F.col("query_id").alias("request_id"), F.col("node_id").alias("id"), "depth")


def _adjacency_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an append-only log: a user's n-th event is version n of its neighbours."""
    from pyspark.sql import Window as W

    rows = table(spark, folder, "events").filter("user_id IS NOT NULL")
    version = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    users = F.array(F.floor(F.col("user_id") / 2), F.col("user_id") + 1, F.col("event_id") % 50)
    return rows.select(F.col("user_id").alias("node_id"), version.alias("version"), users.alias("neighbors"))


def occ_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each node's newest version."""
    found = graph.latest(_adjacency_log(spark, folder))
    return found.select("node_id", "version", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


def occ_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of the log without its last thousand events, and whether they still hold."""
    log = _adjacency_log(spark, folder)
    touched = log.filter("node_id % 3 = 0").select("node_id").distinct()
    return graph.validated(graph.latest(log), graph.latest(graph.bumped(log, touched)))


def occ_traverse(spark: SparkSession, folder: str) -> DataFrame:
    """Traversals of at most 20 nodes over the newest versions."""
    log = _adjacency_log(spark, folder)
    entries = log.filter("node_id % 50 = 0").select(F.col("node_id").alias("request_id"), F.col("node_id").alias("entry_id")).distinct()
    return graph.traverse(log, entries, 20)


def occ_traverse_skips(spark: SparkSession, folder: str) -> DataFrame:
    """The same where users divisible by 3 change between all readings, and are skipped."""
    log = _adjacency_log(spark, folder)
    touched = log.filter("node_id % 3 = 0").select("node_id").distinct()
    readings = [log]
    for _ in range(3):
        readings.append(write_table(graph.bumped(readings[-1], touched), "reading"))
    entries = log.filter("node_id % 50 = 1").select(F.col("node_id").alias("request_id"), F.col("node_id").alias("entry_id")).distinct()
    return graph.traverse(readings[0], entries, 20, readings[1:])


# Snapshots


def _two_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    labels = snapshots.ordered_versions(table(spark, folder, "index_versions"))[-2:]
    rows = write_table(snapshots.current_rows(table(spark, folder, "manifest"), labels), "two-versions")
    old, new = (rows.filter(F.col("version") == label).select("file_path", "digest") for label in labels)
    return old, new


def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Files changed or deleted between the two newest versions, digests taken as they are."""
    return snapshots.manifest_diff(*_two_versions(spark, folder))


def incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of unchanged files, and those of changed files that the newest version lists."""
    old, new = _two_versions(spark, folder)
    diff = write_table(snapshots.manifest_diff(old, new), "manifest-diff")
    chunks = _nodes(spark, folder).select("node_id", "file_path")
    again = chunks.join(diff.filter("status = 'changed'").select("file_path"), "file_path", "left_semi")
    return snapshots.merged(chunks, diff, again).select("node_id", "file_path")


def snapshot_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks saved as a version, activated, and loaded again."""
    from tesserine.session import new_path

    kept = store.SnapshotStore(spark, new_path(spark, "snapshots"))
    kept.save("v1", _nodes(spark, folder), table(spark, folder, "manifest").select("file_path", "digest").distinct())
    kept.activate("v1")
    return kept.load_active().nodes.select("node_id", "file_path", F.sha1(F.coalesce("chunk_text", F.lit(""))).alias("text_sha1"))


def scan_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and digests of this package's own source tree."""
    return repository.manifest(repository.scan(spark, str(Path(__file__).resolve().parent.parent)))


def _two_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All documents as files with digests; and the same after the German ones were deleted, the French changed, the Spanish copied."""
    files = _code_files(spark, folder).withColumn("digest", F.sha1("content"))
    lang = F.coalesce("lang", F.lit(""))
    later = files.filter(lang != "de").withColumn("content", F.when(lang == "fr", F.concat("content", F.lit("\ndef changed_later(x):\n"))).otherwise(F.col("content")))
    copies = files.filter(lang == "es").withColumn("file_path", F.concat(F.lit("copies/"), "file_path"))
    later = later.unionByName(copies).withColumn("digest", F.sha1("content"))
    return files.drop("lang"), later.drop("lang")


def _rebuilt(spark: SparkSession, folder: str) -> manager.IndexManager:
    from tesserine.session import new_path

    built = manager.IndexManager(spark, new_path(spark, "index"))
    for version, files in zip(("v1", "v2"), _two_states(spark, folder), strict=True):
        built.build_files(files, version, relink=version == "v2")
    return built


def index_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the active version after a full build, changes and an incremental build."""
    return _rebuilt(spark, folder).active().nodes.select("file_path", "start_line", "end_line", "symbol")


def index_counters(spark: SparkSession, folder: str) -> DataFrame:
    """What a full and an incremental build count."""
    from tesserine.session import new_path

    built = manager.IndexManager(spark, new_path(spark, "index"))
    rows = [(v, *built.build_files(files, v)) for v, files in zip(("v1", "v2"), _two_states(spark, folder), strict=True)]
    return spark.createDataFrame(rows, "version string, changed bigint, nodes bigint")


def index_asked(spark: SparkSession, folder: str) -> DataFrame:
    """Q9: the final hits of every query on the active version, by a manager."""
    found = _rebuilt(spark, folder).retrieve(table(spark, folder, "queries"), TOP_K)["final_hits"]
    return _hits(found)


def speed_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile of prices by return flag over that of discounts, 0 where there is none."""
    rows = table(spark, folder, "lineitem")
    price, discount = (evaluation.percentiles(rows, "l_returnflag", c, 0.95).select("l_returnflag", F.col("percentile").alias(c)) for c in ("l_extendedprice", "l_discount"))
    return price.join(discount, "l_returnflag").select("l_returnflag", F.round(evaluation.ratio(F.col("l_extendedprice"), F.col("l_discount")), 6).alias("ratio"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p6_found, p6_changes, tokenize, query_expansion, hash_slots, term_freq, doc_freq, idf, avg_doc_len, dense_topk, sparse_bm25_topk,
        symbol_topk, graph_topk, plan_routes, rrf_fusion, retrieve, eval_hit_mrr, chunk_lines, chunk_policy, paths, symbols_python,
        symbols_all, best_symbol, edges_locality, edges_import, edges_symbol_ref, neighbours_final, graph_symmetric, knn_exact,
        knn_filtered, knn_quantised_rerank, recall_at_k, codec_fit, codec_encode, codec_decode_error, project_identity,
        project_rotation, block_assign, io_order, io_merged_ops, percentile_floor_index, bfs_budget_visit_order,
        graph_search_topk, search_stats, bfs_khop, occ_latest, occ_validate, occ_traverse, occ_traverse_skips, manifest_diff,
        incremental_merge, snapshot_roundtrip, scan_manifest, index_rebuilt, index_counters, index_asked, speed_ratio,
    )
}
