"""Random vectors and graphs for demonstrations and timings; the same seed gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_vectors(spark: SparkSession, n: int, dimensions: int, seed: int = 42, normal: bool = True) -> DataFrame:
    """(id, vector): n vectors of standard normal or uniform values."""
    draw = F.randn if normal else F.rand
    return spark.range(n).select("id", F.array(*[draw(seed + d).cast("float") for d in range(dimensions)]).alias("vector"))


def random_graph(spark: SparkSession, n: int, dimensions: int, degree: int, seed: int = 42) -> DataFrame:
    """(id, embedding, neighbors): uniform embeddings, and neighbours other than the node itself that may repeat."""
    if n < 2:
        raise ValueError("a graph needs two nodes")
    nodes = random_vectors(spark, n, dimensions, seed, normal=False).withColumnRenamed("vector", "embedding")
    steps = [F.pmod(F.xxhash64(F.col("id"), F.lit(i), F.lit(seed)), F.lit(n - 1)) + 1 for i in range(degree)]
    return nodes.withColumn("neighbors", F.array(*[F.pmod(F.col("id") + s, F.lit(n)) for s in steps]))
