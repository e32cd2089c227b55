"""tesserine: a PySpark-native engine for code retrieval, vector search and corpus preparation."""

from tesserine.plans.api import (
    BlueGreenIndexManager,
    CodeNode,
    EvalCase,
    EvalReport,
    IndexSnapshot,
    IngestionResult,
    MultiPathRetriever,
    QueryContext,
    RepositoryIngestor,
    RetrievalPlanner,
    RetrievalResponse,
    ScoredNode,
)
from tesserine.plans.manager import IndexManager
from tesserine.session import build_session
from tesserine.sources.store import SnapshotStore

__version__ = "0.2.0"
__all__ = [
    "BlueGreenIndexManager", "CodeNode", "EvalCase", "EvalReport", "IndexManager", "IndexSnapshot", "IngestionResult", "MultiPathRetriever",
    "QueryContext", "RepositoryIngestor", "RetrievalPlanner", "RetrievalResponse", "ScoredNode", "SnapshotStore", "build_session",
]
