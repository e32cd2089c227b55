"""Reading the tables of a data folder: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name in the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
