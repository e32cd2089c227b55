"""Filling containers of fixed capacity with items of varying size: best-two-fit on size classes.

Sizes are whole numbers up to the capacity, so the plan needs only how many items have each size: the
driver holds at most `capacity` counts, however many items there are. A container is filled greedily
(the largest size that still fits); then its smallest item gives way to two unpacked ones that fit the
widened gap more tightly. A fill that all its sizes can still supply is repeated as a run, so the plan's
length follows the number of sizes, not of items. Items are then numbered within their size and find
their container by that number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items in one numbering group; a size with more is numbered in several groups.
GROUP = 200_000


@dataclass
class Run:
    """`times` containers from number `first`, each with `fill[size]` items of each size."""

    first: int
    times: int
    fill: Counter


def _two_fit(sizes: np.ndarray, free: Counter, room: int, least: int) -> tuple[int, int] | None:
    """Two unpacked sizes with the largest sum in (least, room], or None."""
    usable = sizes[sizes <= room]
    if not len(usable):
        return None
    partner = np.searchsorted(usable, room - usable, "right") - 1
    for step in (0, 1):  # one step down where the best partner is the item itself and it has no twin
        at = np.maximum(partner - step, -1)
        sums = np.where(at >= 0, usable + usable[np.maximum(at, 0)], -1)
        for i in np.argsort(-sums, kind="stable")[:4]:
            if sums[i] <= least:
                break
            a, b = int(usable[i]), int(usable[at[i]])
            if a != b or free[a] >= 2:
                return a, b
    return None


def plan_fills(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that pack all items; counts: items of each size from 1 to the capacity."""
    free = Counter({s: n for s, n in counts.items() if n > 0})
    if any(s < 1 or s > capacity for s in free):
        raise ValueError("sizes must lie between 1 and the capacity")
    sizes = np.array(sorted(free))
    runs: list[Run] = []
    first = 0
    while len(sizes):
        fill: Counter = Counter()
        gap, at = capacity, len(sizes) - 1
        while at >= 0:
            size = int(sizes[at])
            take = min(gap // size, free[size])
            if take:
                fill[size] += take
                gap -= take * size
            at = min(at, int(np.searchsorted(sizes, gap, "right"))) - 1
        if gap and len(fill):
            smallest = min(fill)
            left = free - fill
            left[smallest] += 1
            pair = _two_fit(np.array(sorted(s for s in left if left[s] > 0)), left, gap + smallest, smallest)
            if pair and sum(fill.values()) > 1:
                fill[smallest] -= 1
                fill.update(pair)
                fill += Counter()
        times = min(free[s] // n for s, n in fill.items())
        runs.append(Run(first, times, fill))
        first += times
        for s, n in fill.items():
            free[s] -= n * times
        free += Counter()
        sizes = np.array(sorted(free))
    return runs


def _numbered(items: DataFrame, key: str) -> DataFrame:
    """Number items from 0 within their size; sizes held by many items are numbered in groups with offsets."""
    rows = items.count()
    groups = max(1, math.ceil(rows / GROUP))
    grouped = items.withColumn("_g", F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.lit(groups)))
    counts = grouped.groupBy("tokens", "_g").agg(F.count("*").alias("_n"))
    before = W.partitionBy("tokens").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("tokens", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("tokens", "_g").orderBy(key, "piece")) - 1
    return (
        grouped.withColumn("_within", within)
        .join(offsets, ["tokens", "_g"])
        .withColumn("_rank", F.col("_before") + F.col("_within"))
        .drop("_g", "_before", "_within")
    )


def pack(sizes: DataFrame, key: str, capacity: int, sized: str = "tokens") -> DataFrame:
    """(key, piece INT, tokens INT, bin BIGINT): the container of each item, or of each piece of it.

    An item above the capacity is cut into full pieces and a rest, numbered from 0; no other item is cut.
    Items of size 0 or null take no space: they get tokens 0 and container 0. Repeated rows count once.
    No containers for an empty table. Ties between items of one size follow the key. Other columns are
    not read. sizes is read twice; give a written or cheap table.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    whole = F.lit(capacity)
    items = (
        sizes.select(F.col(key), F.coalesce(F.col(sized), F.lit(0)).cast("int").alias("_size"))
        .distinct()
        .withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.col("_size") / whole)).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
        .select(key, "piece", F.least(whole, F.col("_size") - F.col("piece") * whole).cast("int").alias("tokens"))
    )
    counts = {r["tokens"]: r["n"] for r in items.filter("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    used: Counter = Counter()
    rows = []
    for run in plan_fills(counts, capacity):
        for size, each in run.fill.items():
            rows.append((size, used[size], run.first, each))
            used[size] += each * run.times
    rows.sort()
    steps = np.array(rows, np.int64).reshape(-1, 4)
    starts = (steps[:, 0] << 44) + steps[:, 1]
    numbered = _numbered(items.filter("tokens > 0"), key).select(key, "piece", "tokens", "_rank")
    schema = numbered.select(key, "piece", "tokens", F.col("_rank").cast("bigint").alias("bin")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            step = steps[np.searchsorted(starts, (size << 44) + rank, "right") - 1]
            bins = step[:, 2] + (rank - step[:, 1]) // step[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.int64())], schema.names)

    empty = items.filter("tokens <= 0").select(key, "piece", F.lit(0).alias("tokens"), F.lit(0).cast("bigint").alias("bin"))
    return numbered.mapInArrow(place, schema).unionByName(empty)


def pack_all(sizes: DataFrame, key: str, containers: DataFrame) -> DataFrame:
    """(container_id, capacity, bin, key, piece, tokens) for each row of containers, a table of a few rows."""
    kinds = sorted({(r["container_id"], r["capacity"]) for r in containers.select("container_id", "capacity").collect()})
    packed = None
    for kind, capacity in kinds:
        part = pack(sizes, key, capacity).select(
            F.lit(kind).alias("container_id"), F.lit(capacity).alias("capacity"), "bin", key, "piece", "tokens"
        )
        packed = part if packed is None else packed.unionByName(part)
    if packed is None:
        packed = pack(sizes.limit(0), key, 1).select(
            F.lit(0).alias("container_id"), F.lit(0).alias("capacity"), "bin", key, "piece", "tokens"
        )
    return packed
