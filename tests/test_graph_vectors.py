"""Graph search, vectors, read order and percentiles: brute force and hand-derived values."""

import random
from collections import deque

import numpy as np
import pytest

from tesserine.operators import evaluation, graph, vectors


def brute(adjacent, entry, budget):
    if entry not in adjacent or budget < 1:
        return []
    seen, queue, order = {entry}, deque([entry]), []
    while queue and len(order) < budget:
        node = queue.popleft()
        order.append(node)
        for n in adjacent[node] or []:
            if n in adjacent and n not in seen:
                seen.add(n)
                queue.append(n)
    return order


def visits(df):
    out = {}
    for r in df.orderBy("request_id", "pos").collect():
        out.setdefault(r["request_id"], []).append(r["id"])
    return out


def test_visit_order_is_first_in_first_out(spark):
    random.seed(3)
    adjacent = {i: [random.choice([*range(40), 99, None]) for _ in range(5)] for i in range(40)}
    adjacent[7] = None
    nodes = spark.createDataFrame(list(adjacent.items()), "id bigint, neighbors array<bigint>")
    asked = [(1, 0, 12), (2, 5, 100), (3, None, 5), (4, 77, 5), (5, 7, 9), (6, 1, 0), (7, 3, 1)]
    found = visits(graph.visit_order(nodes, spark.createDataFrame(asked, "request_id bigint, entry_id bigint, max_visit int")))
    assert found == {r: brute(adjacent, e, b) for r, e, b in asked if brute(adjacent, e, b)}


def test_visits_end_at_the_budget_and_skip_unknown_ids(spark):
    nodes = spark.createDataFrame([(0, [9, 2, None, 1, 2]), (1, [3]), (2, [3, 0, 4]), (3, []), (4, None)], "id bigint, neighbors array<bigint>")
    asked = [(1, 0, 3), (2, 0, 99), (3, 9, 5), (4, None, 5), (5, 2, 0), (6, 3, 5), (7, 2, 1)]
    requests = spark.createDataFrame(asked, "request_id bigint, entry_id bigint, max_visit int")
    found = visits(graph.visit_order(nodes, requests))
    assert found == {1: [0, 2, 1], 2: [0, 2, 1, 3, 4], 6: [3], 7: [2]}
    assert graph.visit_order(nodes.limit(0), requests).count() == 0 and graph.visit_order(nodes, requests.limit(0)).count() == 0


def test_search_filters_after_the_visits(spark):
    nodes = spark.createDataFrame([(0, [0.0, 0.0], [1, 2]), (1, [1.0, 0.0], []), (2, [0.0, 2.0], []), (3, None, [])], "id bigint, embedding array<float>, neighbors array<bigint>")
    asked = spark.createDataFrame([(9, [0.0, 0.0], 2, 0, 10)], "request_id bigint, query array<float>, top_k int, entry_id bigint, max_visit int")
    visited = graph.visit_order(nodes, asked)
    found = graph.search(visited, nodes, asked, visited["id"] != 0)
    assert [(r["id"], r["distance"]) for r in found.orderBy("rank").collect()] == [(1, 1.0), (2, 2.0)]
    stats = graph.search_stats(visited, visited["id"] != 0).first()
    assert (stats["visited"], stats["filtered_nodes"]) == (3, 1)


def test_versioned_adjacency(spark):
    log = spark.createDataFrame([(0, 1, [1, 2]), (1, 1, [3]), (2, 1, [4]), (3, 1, []), (4, 1, []), (5, 1, [])], "node_id bigint, version bigint, neighbors array<bigint>")
    start = spark.createDataFrame([(1, 0)], "request_id bigint, entry_id bigint")
    assert visits(graph.traverse(log, start, 6))[1] == [0, 1, 2, 3, 4]
    new = graph.with_neighbours(log, spark.createDataFrame([(2, [4, 5]), (3, [5]), (99, [1])], "node_id bigint, neighbors array<bigint>"))
    assert visits(graph.traverse(new, start, 6))[1] == [0, 1, 2, 3, 4, 5]
    again = graph.bumped(log, spark.createDataFrame([(2,)], "node_id bigint"))
    twice = graph.bumped(again, spark.createDataFrame([(2,)], "node_id bigint"))
    assert visits(graph.traverse(log, start, 6, [again, twice]))[1] == [0, 1, 3]  # 2 changed during both attempts
    assert visits(graph.traverse(log, start, 6, [again, again]))[1] == [0, 1, 2, 3, 4]
    touched = graph.bumped(log, spark.createDataFrame([(1,), (98,)], "node_id bigint"))
    valid = {r["node_id"]: r["valid"] for r in graph.validated(graph.latest(log), graph.latest(touched)).collect()}
    assert valid == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True}


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(1).standard_normal((300, 8)).astype(np.float32)


def frame(spark, points, names="id bigint, vector array<float>"):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], names)


def test_exact_and_quantised(spark, points):
    points = points.copy()
    points[11] = points[10]
    rows, asked = frame(spark, points), frame(spark, points[:20], "qid bigint, query array<float>")
    found = vectors.exact_nearest(rows, asked, 5)
    gaps = np.sqrt(((points[:20, None].astype(float) - points[None].astype(float)) ** 2).sum(2))
    want = {q: [int(i) for i in np.lexsort((np.arange(300), gaps[q]))[:5]] for q in range(20)}
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want
    whole = vectors.quantised_nearest(rows, asked, 5, rerank_k=300)
    assert vectors.recall(found, whole, 5).first()["recall"] == 1.0
    assert vectors.exact_nearest(rows, asked, 0).count() == 0 and vectors.exact_nearest(rows, asked.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        vectors.fit_codec(rows, 8)


def test_vectors_in_parts_and_blocks(spark, points, monkeypatch):
    rows, asked = frame(spark, points), frame(spark, points[:11], "qid bigint, query array<float>")
    found = lambda: sorted(map(tuple, vectors.exact_nearest(rows, asked, 4).collect()))
    whole = found()
    for name, value in (("QUERY_BLOCK", 2), ("PART", 40), ("STEP", 16)):
        monkeypatch.setattr(vectors, name, value)
    assert found() == whole and len(whole) == 44
    gaps = ((points[:11, None].astype(float) - points[None]) ** 2).sum(2)
    assert {(q, i) for q, i, _, _ in whole} == {(q, int(i)) for q in range(11) for i in np.argsort(gaps[q], kind="stable")[:4]}


def test_timed_evaluation(spark, points):
    found = vectors.timed_evaluation(frame(spark, points), frame(spark, points[:2], "qid bigint, query array<float>"), 5)
    assert found["recall"] > 0.9 and found["exact_p95_ms"] > 0 and found["ratio"] > 0


def test_codec(points):
    low, scale = np.zeros(1, np.float32), np.ones(1, np.float32)
    assert vectors.encode(np.array([[2.5], [-1], [99]], np.float32), low, scale, 4).ravel().tolist() == [3, 0, 15]
    low, scale = points.min(0), (63 / (points.max(0) - points.min(0))).astype(np.float32)
    back = vectors.decode(vectors.encode(points, low, scale), low, scale)
    assert (np.abs(back - points) * scale <= 0.5001).all()


def test_merged_reads_and_order(spark):
    blocks = spark.createDataFrame(list(enumerate([0, 0, 1, 3, 4, 7])), "id bigint, block_id bigint")
    assert vectors.merged_reads(blocks).first()["ops"] == 3 and vectors.merged_reads(blocks, 2).first()["ops"] == 3
    assert vectors.merged_reads(blocks.limit(0)).first()["ops"] == 0
    ordered = [(r["id"], r["batch"]) for r in vectors.read_order(blocks, 4, 2).orderBy("pos").collect()]
    assert ordered == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]


@pytest.mark.parametrize("n,index", [(20, 18), (60, 56), (120, 113)])
def test_percentile_index(spark, n, index):
    rows = spark.createDataFrame([("g", float(i)) for i in range(n)] + [("g", None)], "g string, v double")
    assert evaluation.percentiles(rows, "g", "v", 0.95).first()["percentile"] == index
