"""Chunk ranges, symbols, scanning a folder, building and asking an index, and the stream of files."""

import pytest

from tesserine.functions import text as columns
from tesserine.operators import chunking, symbols
from tesserine.plans.manager import IndexManager
from tesserine.session import new_path
from tesserine.sources.repository import scan
from tesserine.sources.store import SnapshotStore
from tesserine.streaming.incremental import index_stream, merge_batch
from tesserine import BlueGreenIndexManager, CodeNode, EvalCase, MultiPathRetriever, QueryContext, RepositoryIngestor, RetrievalPlanner
from tesserine.plans.api import node_table
from pyspark.sql import functions as F


def ranges(spark, path, n):
    files = spark.createDataFrame([(path, "\n".join(f"line {i}" for i in range(n)))], "file_path string, content string")
    return [(r["start_line"], r["end_line"]) for r in chunking.chunk_files(files).orderBy("start_line").collect()]


def test_chunk_ranges(spark):
    assert ranges(spark, "m/a.py", 300) == [(1, 100), (76, 175), (151, 250), (226, 300)]
    assert ranges(spark, "m/a.md", 121) == [(1, 121)]
    assert ranges(spark, "a.py", 1) == [(1, 1)]


@pytest.mark.parametrize("n,language,want", [(120, "python", (120, 0)), (121, "python", (100, 25)), (501, "go", (130, 30)), (1001, "c", (160, 35)), (501, "markdown", (170, 35)), (1001, "markdown", (200, 40))])
def test_chunk_policy(spark, n, language, want):
    size, overlap = chunking.chunk_policy(F.lit(n), F.lit(language))
    assert tuple(spark.range(1).select(size, overlap).first()) == want


def test_lines_as_splitlines(spark):
    for text in ("", "a", "a\n", "a\n\n", "a\x0bb\x85c d", None):
        found = spark.createDataFrame([(text,)], "t string").select(columns.lines(F.col("t"))).first()[0]
        assert found == (text or "").splitlines()


def test_symbol_line_is_that_of_the_blank_lines_above(spark):
    files = spark.createDataFrame([("a", "python", "\n\ndef a():\n  pass\n"), ("b", "go", "func go(x int) {"), ("c", None, None)], "file_path string, language string, content string")
    found = {(r["file_path"], r["name"]): r["line"] for r in symbols.file_symbols(files).collect()}
    assert found[("a", "a")] == 1 and ("b", "go") in found


def test_build_ask_and_incremental(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "core").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "core/store.py").write_text("import util\n\ndef save_index(path):\n    return write(path)\n")
    (root / "core/util.py").write_bytes(b"def write(path):\r\n    return path \xff\n")
    (root / "build/skip.py").write_text("def no(): pass\n")
    (root / "core/empty.py").write_text("")
    (root / "top.txt").write_text("no source")
    assert {r["file_path"] for r in scan(spark, str(root)).collect()} == {"core/store.py", "core/util.py", "core/empty.py"}
    manager = IndexManager(spark, new_path(spark, "index"))
    with pytest.raises(RuntimeError):
        manager.active()
    assert manager.build(str(root), "v1") == (3, 2)
    nodes = {r["file_path"]: r for r in manager.active().nodes.collect()}
    assert nodes["core/store.py"]["symbol"] == "save_index" and nodes["core/store.py"]["neighbors"] == [nodes["core/util.py"]["node_id"]]
    best = manager.ask("save index path", hint="save_index", top_k=2).first()
    assert best["file_path"] == "core/store.py" and best["rank"] == 1
    (root / "core/util.py").unlink()
    (root / "core/new.py").write_text("def fresh():\n    pass\n")
    assert manager.build(str(root), "v2") == (2, 2)
    assert {r["file_path"] for r in manager.active().nodes.collect()} == {"core/store.py", "core/new.py"}
    manager.activate("v1")
    assert manager.active().nodes.count() == 2
    with pytest.raises(KeyError):
        manager.activate("v9")


def test_a_planner_can_add_and_leave_out_routes(spark, chunks):
    nodes = chunks([{"node_id": "a", "module": "m", "file_path": "m/a.py", "symbol": "load_index", "chunk_text": "def load_index(): pass"}])

    class Planner(RetrievalPlanner):
        def routes(self, queries):
            return queries.select("query_id", F.array(F.lit("symbol")).alias("routes"))

    query = QueryContext("load it", symbol_hint="")
    assert RetrievalPlanner().plan(spark, query) == ["dense", "sparse", "graph"]
    found = MultiPathRetriever(nodes, Planner()).retrieve(QueryContext("the load_index"))
    assert found.routes == ["symbol"] and [h.node_id for h in found.route_hits["symbol"]] == ["a"] and found.final_hits[0].node_id == "a"


def test_public_names(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.py").write_text("def alpha():\n    return 1\n")
    (tmp_path / "_top.py").write_text("def top():\n    return 1\n")
    got = RepositoryIngestor(spark, str(tmp_path)).ingest(spark.createDataFrame([("m/a.py",)], "file_path string"))
    assert [r["file_path"] for r in got.manifest.collect()] == ["m/a.py"]
    manager = BlueGreenIndexManager(spark, new_path(spark, "index"))
    assert manager.build("file://" + str(tmp_path), "v1") == (2, 2)
    nodes = {r["file_path"]: r["node_id"] for r in manager.active().nodes.collect()}
    cases = [EvalCase("one", QueryContext("alpha return", symbol_hint="alpha"), nodes["m/a.py"]), EvalCase("none", QueryContext("top"), "gone")]
    report = manager.report(cases)
    assert (report.total, report.hit_at_5) == (2, 0.5) and report.mrr == 0.5
    assert manager.ask_context(cases[0].query, 1).final_hits[0].node_id == nodes["m/a.py"]
    manager.swap("v2", node_table(spark, [CodeNode("x", "m", "m/x.py", "x", "python", "text")]), spark.createDataFrame([("m/x.py", "1")], "file_path string, digest string"))
    assert manager.active().version == "v2" and manager.active().nodes.count() == 1


def test_a_batch_meets_a_version_of_any_label(spark):
    store = SnapshotStore(spark, new_path(spark, "stream"))
    shape = "file_path string, content string, sequence int"
    merge_batch(store, spark.createDataFrame([("m/a.py", "def a():\n  pass\n", 1)], shape), 0)
    active = store.load_active()
    store.save("v2026", active.nodes, active.manifest)  # as a manager's build
    store.activate("v2026")
    rows = [("m/b.py", "def late():\n  pass\n", 9), ("m/b.py", "def earlier_but_longer():\n  pass\n", 2)]
    for _ in range(2):
        merge_batch(store, spark.createDataFrame(rows, shape), 1)
    assert {r["symbol"] for r in store.load_active().nodes.collect()} == {"a", "late"}
    assert store.active_version() == "stream-000000000001" and store.load_active().batches == {"stream": 1}
    merge_batch(store, spark.createDataFrame([("m/c.py", "def c(): pass", 1)], shape), 0)
    assert store.load_active().nodes.count() == 2  # that batch is in it


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("m/a.py", "def a():\n  pass\n"), ("m/b.py", "def b():\n  pass\n")], "file_path string, content string")
    rows.coalesce(1).write.parquet(str(source))
    store = SnapshotStore(spark, new_path(spark, "stream"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(source))
    for _ in range(2):
        index_stream(read(), store, str(tmp_path / "check")).awaitTermination(120)
    assert store.load_active().nodes.count() == 2
    spark.createDataFrame([("m/a.py", "def again():\n  pass\n")], rows.schema).coalesce(1).write.mode("append").parquet(str(source))
    index_stream(read(), store, str(tmp_path / "check")).awaitTermination(120)
    assert {r["symbol"] for r in store.load_active().nodes.collect()} == {"again", "b"}
