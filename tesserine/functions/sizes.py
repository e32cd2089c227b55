"""Joins whose small side is broadcast only after its size was counted; stated queries that meet all rows in blocks."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import new_path, write_at


def bounded_rows(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows; it reads no more than needed to tell."""
    return df.limit(most + 1).count() <= most


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = 100_000) -> DataFrame:
    """Join by broadcast if small has at most `most` rows, else by shuffling both sides.

    small should be cheap to compute twice (written or persisted), as it is counted first.
    """
    if bounded_rows(small, most):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def _parts_and_blocks(rows: DataFrame, queries: DataFrame, part: int, block: int) -> tuple[int, int]:
    n, workers = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / part), min(2 * workers, math.ceil(16 * n / part)))
    return parts, max(1, math.ceil(queries.count() / block))


def meet(
    rows: DataFrame, row_key: str, queries: DataFrame, query_key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, part: int, block: int,
    counted: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """run(rows, queries) of each part of the rows with each block of a stated set of queries, as tasks of their own.

    Parts have about `part` rows, or fewer where that would leave workers idle, blocks at most about `block` queries. Rows move
    once for each block, queries once for each part; nothing goes through the driver. counted: tables of as many rows as
    the two that are cheaper to count.
    """
    parts, blocks = _parts_and_blocks(*(counted or (rows, queries)), part, block)
    left = rows.withColumn("_part", F.pmod(F.xxhash64(row_key), F.lit(parts))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_at_block", F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int"))
    right = right.withColumn("_at_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return left.groupBy("_part", "_block").cogroup(right.groupBy("_at_part", "_at_block")).applyInArrow(run, schema)


def meet_in_place(
    rows: DataFrame, queries: DataFrame, query_key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, part: int, block: int,
    counted: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """run(rows, queries) of each part of the rows with each block of a stated set of queries.

    Parts have at most about `part` rows, or fewer where that would leave workers idle, blocks at most about `block` queries. Rows
    stay where they are read; blocks are written, and every part reads them one by one. Nothing goes through the driver.
    counted: tables of as many rows as the two that are cheaper to count.
    """
    parts, blocks = _parts_and_blocks(*(counted or (rows, queries)), part, block)
    at = new_path(rows.sparkSession, "blocks")
    placed = queries.withColumn("_at_block", F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int"))
    write_at(placed.repartition(blocks, "_at_block"), at, "_at_block")
    asks = queries.columns

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(at)
        found = [f.path for f in files.get_file_info(fs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet")]
        by_block: dict[str, list[str]] = {}
        for path in sorted(found):
            by_block.setdefault(path.rpartition("/")[0], []).append(path)

        def of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for paths in by_block.values():
                asking = pa.concat_tables([pq.ParquetFile(files.open_input_file(p)).read(asks) for p in paths])
                yield from run(pa.Table.from_batches(held), asking).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= part:
                yield from of(held)
                held = []
        if any(map(len, held)):
            yield from of(held)
        held = []
        pa.default_memory_pool().release_unused()  # workers live on beside the JVM
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return rows.coalesce(parts).mapInArrow(met, schema)
