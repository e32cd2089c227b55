"""Generated graphs, and the bitmap filter."""

from tesserine.operators.graph import passing
from tesserine.sources.generators import random_graph, random_vectors


def test_random_graph(spark):
    rows = random_graph(spark, 50, 4, 6).collect()
    assert len(rows) == 50 and all(len(r["neighbors"]) == 6 and r["id"] not in r["neighbors"] for r in rows)
    assert all(0 <= n < 50 for r in rows for n in r["neighbors"]) and all(0 <= x < 1 for r in rows for x in r["embedding"])
    assert random_vectors(spark, 5, 3).collect() == random_vectors(spark, 5, 3).collect()


def test_passing(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    bitmap = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (2, 2)], "id bigint, pass int")
    assert sorted(r["id"] for r in passing(nodes, bitmap).collect()) == [0, 3]
