"""Session settings, the shared folder, and writing intermediate tables that survive a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every scale; sizes of partitions are left to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests, benches and command lines; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("tesserine").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it isn't installed; call it before the first query."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(context, "_tesserine_dir", None)
        if path is None:
            path = "file://" + tempfile.mkdtemp(prefix="tesserine-")
            context._tesserine_dir = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_at(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write df to a path that new_path gave; release deletes it."""
    _written(df.sparkSession).append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write_at(df, path, *partition_by)
    return spark.read.schema(df.schema).parquet(path)


def _written(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_tesserine_written"):
        context._tesserine_written = []
    return context._tesserine_written


def release(spark: SparkSession) -> int:
    """Delete the tables that write_table wrote in this session, once no result that reads them is needed; gives how many."""
    paths = _written(spark)
    for path in paths:
        drop_path(spark, path)
    n = len(paths)
    paths.clear()
    return n


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that new_path gave."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_path(path: str) -> str:
    """The path without its file: scheme."""
    return path[7:] if path.startswith("file://") else os.fspath(path)
