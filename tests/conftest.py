"""One session for all tests."""

import os

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

from tesserine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "3g")
    yield session
    session.stop()


CHUNKS = (
    "node_id string, module string, file_path string, symbol string, language string, chunk_text string, start_line int, end_line int, "
    "metadata map<string,string>, neighbors array<string>"
)


@pytest.fixture
def chunks(spark):
    """Make a chunks table of dicts; missing columns are null."""

    def make(rows):
        names = [c.split()[0] for c in CHUNKS.replace("map<string,string>", "map").split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CHUNKS)

    return make
