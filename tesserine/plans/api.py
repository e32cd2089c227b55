"""Single questions and small lists as plain Python values, over the operators on tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import retrieval
from tesserine.plans.manager import QUERY_COLUMNS, IndexManager
from tesserine.sources.repository import ingest, manifest, scan
from tesserine.sources.store import Snapshot as IndexSnapshot


@dataclass
class CodeNode:
    """A chunk of a file."""

    node_id: str
    module: str
    file_path: str
    symbol: str | None
    language: str | None
    chunk_text: str
    start_line: int = 1
    end_line: int = 1
    metadata: dict[str, str] = field(default_factory=dict)
    neighbors: list[str] = field(default_factory=list)


@dataclass
class QueryContext:
    """A question and what it is limited to."""

    text: str
    module_scope: str | None = None
    language: str | None = None
    symbol_hint: str | None = None
    graph_hops: int = 2


@dataclass
class ScoredNode:
    """A hit of a route."""

    node_id: str
    route: str
    score: float
    rank: int


@dataclass
class RetrievalResponse:
    """A question's routes, the hits of each, the fused ones and the final ones."""

    routes: list[str]
    route_hits: dict[str, list[ScoredNode]]
    fused_hits: list[ScoredNode]
    final_hits: list[ScoredNode]


@dataclass
class EvalCase:
    """A question and the node that should answer it."""

    name: str
    query: QueryContext
    expected_node_id: str


@dataclass
class EvalReport:
    """How many cases there were, the share answered in the first five hits, and the mean reciprocal rank."""

    total: int
    hit_at_5: float
    mrr: float


@dataclass
class IngestionResult:
    """The nodes of files and their manifest (file_path, digest), as tables."""

    nodes: DataFrame
    manifest: DataFrame


NODE_COLUMNS = (
    "node_id string, module string, file_path string, symbol string, language string, chunk_text string, start_line int, end_line int, "
    "metadata map<string,string>, neighbors array<string>"
)


def node_table(spark: SparkSession, nodes: list[CodeNode]) -> DataFrame:
    return spark.createDataFrame([tuple(vars(n).values()) for n in nodes], NODE_COLUMNS)


def query_table(spark: SparkSession, queries: list[QueryContext]) -> DataFrame:
    """The questions, numbered from 0."""
    return spark.createDataFrame([(i, *asdict(q).values()) for i, q in enumerate(queries)], QUERY_COLUMNS)


class RetrievalPlanner:
    """Which routes a question takes; a planner of one's own overrides routes()."""

    def routes(self, queries: DataFrame) -> DataFrame:
        """(query_id, routes) of a table of questions."""
        return retrieval.plan(queries)

    def plan(self, spark: SparkSession, query: QueryContext) -> list[str]:
        return self.routes(query_table(spark, [query])).first()["routes"]


class MultiPathRetriever:
    """Asks a table of nodes."""

    def __init__(self, nodes: DataFrame, planner: RetrievalPlanner | None = None) -> None:
        self.nodes, self.planner = retrieval.distinct_nodes(nodes), planner or RetrievalPlanner()

    def retrieve(self, query: QueryContext, top_k: int = 8) -> RetrievalResponse:
        """One question's hits, at most top_k of each route and of the end."""
        asked = query_table(self.nodes.sparkSession, [query])
        planned = self.planner.routes(asked)
        found = retrieval.retrieve(self.nodes, asked, top_k, planned)
        lists = {name: _hits(rows, top_k) for name, rows in found.items()}
        routes = planned.first()["routes"]
        by_route = {r: [h for h in lists["route_hits"] if h.route == r] for r in routes}
        return RetrievalResponse(routes, by_route, lists["fused_hits"], lists["final_hits"])


def _hits(rows: DataFrame, top_k: int) -> list[ScoredNode]:
    kept = rows.filter(F.col("rank") <= top_k).orderBy("route", "rank").select("node_id", "route", "score", "rank")
    return [ScoredNode(*r) for r in kept.collect()]  # one question


class RepositoryIngestor:
    """Reads a folder of source files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def scan_manifest(self) -> DataFrame:
        """(file_path, digest) of the source files."""
        return manifest(scan(self.spark, self.root))

    def ingest(self, only: DataFrame | None = None) -> IngestionResult:
        """Nodes and manifest of the files, or of those that only (file_path) names."""
        files = scan(self.spark, self.root, only)
        return IngestionResult(ingest(files), manifest(files))


class BlueGreenIndexManager(IndexManager):
    """An index manager that takes single questions and lists of cases."""

    def ask_context(self, query: QueryContext, top_k: int = 8) -> RetrievalResponse:
        planner = RetrievalPlanner()
        if self.planner is not None:
            planner.routes = self.planner
        return MultiPathRetriever(self.active().nodes, planner).retrieve(query, top_k)

    def report(self, cases: list[EvalCase]) -> EvalReport:
        """How the active version answers cases."""
        expected = self.spark.createDataFrame([(c.name, i, c.expected_node_id) for i, c in enumerate(cases)], "name string, query_id bigint, expected_node_id string")
        return EvalReport(*self.evaluate(expected, query_table(self.spark, [c.query for c in cases])).first())


__all__ = [
    "BlueGreenIndexManager", "CodeNode", "EvalCase", "EvalReport", "IndexSnapshot", "IngestionResult", "MultiPathRetriever",
    "QueryContext", "RepositoryIngestor", "RetrievalPlanner", "RetrievalResponse", "ScoredNode",
]
