"""Routes, fusion and reranking: hand-made values, null handling, and the SQL of the oracle on the smallest data."""

import duckdb
import pytest

from tesserine.operators import retrieval
from tesserine.plans.oracle import ORACLE
from tesserine.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
QUERY = "query_id bigint, text string, module_scope string, language string, symbol_hint string, graph_hops int"


@pytest.fixture
def nodes(chunks):
    return chunks(
        [
            {"node_id": "a", "module": "core", "file_path": "core/a.py", "symbol": "loadIndex", "language": "Python", "chunk_text": "alpha beta", "neighbors": ["b", "gone"]},
            {"node_id": "b", "module": "core", "file_path": "core/b.go", "symbol": "load", "language": "go", "chunk_text": "beta gamma", "neighbors": None},
            {"node_id": "c", "module": None, "file_path": None, "symbol": None, "language": None, "chunk_text": None, "neighbors": ["b"]},
        ]
    )


def ask(spark, **given):
    row = {"query_id": 1, "text": "beta", "module_scope": None, "language": None, "symbol_hint": None, "graph_hops": 2} | given
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in QUERY.split(", "))], QUERY)


def hits(df):
    return [(r["node_id"], round(r["score"], 6), r["rank"]) for r in df.orderBy("rank").collect()]


def test_sparse_and_filters(spark, nodes):
    found = hits(retrieval.sparse(nodes, ask(spark)))
    assert {h[0] for h in found} == {"a", "b"}
    assert [h[0] for h in hits(retrieval.sparse(nodes, ask(spark, language="GO")))] == ["b"]
    assert hits(retrieval.sparse(nodes, ask(spark, module_scope="nowhere"))) == []
    assert {h[0] for h in hits(retrieval.sparse(nodes, ask(spark, module_scope="", language="")))} == {"a", "b"}


def test_sparse_ranks_the_best_of_each_part_only(spark, chunks, monkeypatch):
    nodes = chunks([{"node_id": f"n{i:03}", "module": None if i % 3 else "Core", "chunk_text": "beta " * (1 + i % 5)} for i in range(400)])
    queries = spark.createDataFrame([(i, "beta zzz", "core" if i % 2 else None, None, None, 2) for i in range(20)], QUERY)
    ranked, top = [], retrieval.top
    monkeypatch.setattr(retrieval, "top", lambda scored, *rest: ranked.append(scored.count()) or top(scored, *rest))
    whole = sorted(map(tuple, retrieval.sparse(nodes, queries, 3).collect()))
    assert ranked[0] <= 20 * 3 * 2 * spark.sparkContext.defaultParallelism  # all pairs are 5,340
    by_query = {q: [r[2] for r in whole if r[0] == q] for q in (0, 1)}
    assert [len({r[0] for r in whole}), len(whole)] == [20, 60] and all(int(n[1:]) % 3 == 0 for n in by_query[1])
    for name, value in (("QUERY_BLOCK", 1), ("NODE_PART", 50)):
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(map(tuple, retrieval.sparse(nodes, queries, 3).collect())) == whole


def test_nodes_stay_where_they_are_read(spark, nodes):
    counted = retrieval.counted_words(nodes)
    assert retrieval.counted_words(counted) is counted and "chunk_text" not in counted.columns
    held = {r["node_id"]: (dict(zip(r["words"].split(), r["times"], strict=True)), r["dl"]) for r in counted.collect()}
    assert held["a"] == ({"core": 2, "py": 1, "loadindex": 1, "alpha": 1, "beta": 1}, 6) and held["c"] == ({}, 0)
    asked = retrieval.distinct_queries(ask(spark))
    assert "CoGroup" not in retrieval.dense(nodes, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert hits(retrieval.sparse(counted, asked)) == hits(retrieval.sparse(nodes, asked))


def test_dense_keeps_nodes_without_common_words(spark, nodes):
    found = hits(retrieval.dense(nodes, ask(spark, text="zzz")))
    assert [h[0] for h in found] == ["a", "b", "c"] and found[2][1] == 0.0


def test_symbol_scores(spark, nodes):
    assert hits(retrieval.symbol(nodes, ask(spark, symbol_hint=" LOAD "))) == [("b", 1.0, 1), ("a", 0.85, 2)]
    assert hits(retrieval.symbol(nodes, ask(spark, symbol_hint="index"))) == [("a", 0.7, 1)]
    assert hits(retrieval.symbol(nodes, ask(spark, text="the loadindex"))) == [("a", 1.0, 1)]
    assert hits(retrieval.symbol(nodes, ask(spark, text="nothing"))) == []


def test_parts_and_blocks_change_nothing(spark, monkeypatch):
    nodes = retrieval.distinct_nodes(spark.read.parquet(f"{FOLDER}/chunks.parquet")).cache()
    queries = retrieval.distinct_queries(spark.read.parquet(f"{FOLDER}/queries.parquet")).cache()
    found = lambda: [sorted(map(tuple, route(nodes, queries, 3).collect())) for route in (retrieval.dense, retrieval.symbol)]
    whole = found()
    for name, value in (("QUERY_BLOCK", 3), ("NODE_PART", 10), ("STEP", 7)):
        monkeypatch.setattr(retrieval, name, value)
    assert found() == whole and all(whole)


def test_graph_passes_what_the_scope_leaves_out(spark, nodes):
    found = hits(retrieval.graph(nodes, ask(spark, symbol_hint="loadindex", language="go")))
    assert found == [("b", 1.0, 1)] or found == [("b", 0.5, 1)]
    wide = dict((h[0], h[1]) for h in hits(retrieval.graph(nodes, ask(spark, symbol_hint="loadindex"))))
    assert wide == {"a": 1.0, "b": 0.5, "c": round(1 / 3, 6)}


def test_fusion_of_rank_one_in_four_routes(spark):
    rows = [(1, r, "n", 1.0, 1) for r in retrieval.ROUTES]
    fused = retrieval.fuse(spark.createDataFrame(rows, "query_id bigint, route string, node_id string, score double, rank int"), 4)
    assert hits(fused) == [("n", round(4 / 61, 6), 1)]


def test_plan(spark):
    routes = {t: retrieval.plan(ask(spark, text=t)).first()["routes"] for t in ("plain", "a::b", "f(", "MyService")}
    assert routes["plain"] == ["dense", "sparse", "graph"] and all(len(routes[t]) == 4 for t in ("a::b", "f(", "MyService"))


def test_empty_tables(spark, chunks, nodes):
    none = ask(spark).limit(0)
    assert retrieval.retrieve(nodes, none)["final_hits"].count() == 0
    assert retrieval.retrieve(chunks([]), ask(spark))["final_hits"].count() == 0
    report = retrieval.evaluate(spark.createDataFrame([], "name string, query_id bigint, expected_node_id string"), retrieval.retrieve(nodes, none)["final_hits"]).first()
    assert (report["total"], report["hit_at_5"], report["mrr"]) == (0, 0.0, 0.0)


def _rows(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


NAMES = [
    "tokenize", "hash_slots", "idf", "dense_topk", "sparse_bm25_topk", "symbol_topk", "graph_topk", "retrieve", "chunk_lines", "chunk_policy",
    "edges_locality", "edges_import", "edges_symbol_ref", "neighbours_final", "knn_exact", "knn_quantised_rerank", "codec_encode", "io_order",
    "io_merged_ops", "percentile_floor_index", "bfs_khop", "occ_validate", "manifest_diff", "incremental_merge",
]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import os

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.partition('.')[0]} as from '{FOLDER}/{file}'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert _rows(found.select(*columns).collect()) == _rows(want)
