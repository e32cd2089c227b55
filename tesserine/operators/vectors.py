"""Nearest vectors, exact and through a scalar quantiser with exact reranking; the order of block reads.

The queries are a stated set: each part of the vectors meets a block of them and keeps the best of each query, so what is
moved then is k rows for a query and part.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.functions.sizes import meet

#: Queries of a block, and vectors of a part, that meet in one task.
QUERY_BLOCK, PART = 10_000, 200_000
#: Vectors that are measured at once.
STEP = 2048


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, by differences, dimension by dimension."""
    total = np.zeros((len(queries), len(points)))
    for d in range(queries.shape[1]):
        gap = queries[:, d : d + 1].astype(np.float64) - points[:, d].astype(np.float64)
        total += gap * gap
    return np.sqrt(total)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy(*by, "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _candidates(vectors: DataFrame, queries: DataFrame, keep: int, codec: tuple[np.ndarray, np.ndarray] | None = None, bits: int = 6) -> DataFrame:
    """(qid, id, coarse, distance): of each batch the best `keep` of each query, by the distance to what the codec
    gives back, or without a codec by the exact distance."""

    def measure(held: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["qid", "id", "coarse", "distance"]
        if not len(held) or not len(asking):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        ids = asking.column("qid").to_numpy()
        flat = np.asarray(asking.column("query").combine_chunks().flatten(), np.float32)
        asked = flat.reshape(len(ids), -1)
        held = held.take(pa.array(np.argsort(held.column("id").to_numpy(), kind="stable")))
        best = np.full((3, len(ids), 0), np.inf)  # coarse, exact, place
        for first in range(0, len(held), STEP):
            step = held.slice(first, STEP)
            points = np.asarray(step.column("vector").combine_chunks().flatten(), np.float32)
            if len(points) != len(step) * asked.shape[1]:
                raise ValueError("vectors and queries must have one length")
            points = points.reshape(-1, asked.shape[1])
            exact = _distances(asked, points)
            coarse = exact if codec is None else _distances(asked, decode(encode(points, *codec, bits), *codec))
            places = np.broadcast_to(np.arange(first, first + len(step), dtype=float), exact.shape)
            both = np.concatenate([best, np.stack([coarse, exact, places])], 2)
            order = np.argsort(both[0], 1, kind="stable")[:, :keep]  # earlier ones, with smaller ids, first
            best = np.stack([np.take_along_axis(x, order, 1) for x in both])
        found = held.column("id").take(pa.array(best[2].ravel().astype(np.int64)))
        return pa.table([pa.array(np.repeat(ids, best.shape[2])), found, pa.array(best[0].ravel()), pa.array(best[1].ravel())], names)

    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("query").cast("array<float>").alias("query")).filter("query IS NOT NULL")
    return meet(rows, "id", asked, "qid", measure, "qid bigint, id bigint, coarse double, distance double", PART, QUERY_BLOCK)


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, distance, rank): the k vectors (id, vector) nearest to each query (qid, query); ties by id; k < 1 gives none."""
    if k < 1:
        return _candidates(vectors, queries.limit(0), 1).select("qid", "id", "distance", F.lit(0).alias("rank"))
    return _ranked(_candidates(vectors, queries, k), ["distance"], k).select("qid", "id", "distance", "rank")


def fit_codec(vectors: DataFrame, bits: int) -> DataFrame:
    """(i, low, scale): for each dimension the least value, and steps to a unit; one row for each dimension."""
    if not 4 <= bits <= 7:
        raise ValueError("bits must lie between 4 and 7")
    values = vectors.select(F.posexplode("vector").alias("i", "x"))
    fitted = values.groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("_high"))
    span = F.greatest((F.col("_high") - F.col("low")).cast("float"), F.lit(1e-6).cast("float"))
    return fitted.select("i", "low", (F.lit(float(2**bits - 1)) / span.cast("double")).cast("float").alias("scale"))


def codec_arrays(codec: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(low, scale) of a fitted codec, whose rows are its dimensions."""
    rows = codec.orderBy("i").collect()
    if not rows:
        raise ValueError("a codec needs vectors to be fitted on")
    return np.array([r["low"] for r in rows], np.float32), np.array([r["scale"] for r in rows], np.float32)


def encode(points: np.ndarray, low: np.ndarray, scale: np.ndarray, bits: int = 6) -> np.ndarray:
    """Codes of vectors, rounded half away from zero and clamped."""
    scaled = ((points - low) * scale).astype(np.float64)
    return np.floor(np.clip(scaled, 0, 2**bits - 1) + 0.5).astype(np.float32)


def decode(codes: np.ndarray, low: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    return codes / scale + low


def quantised_nearest(
    vectors: DataFrame, queries: DataFrame, k: int, rerank_k: int = 64, bits: int = 6, codec: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """(qid, id, distance, rank): the best max(k, rerank_k) by decoded vectors, reranked by exact distance, cut to k."""
    codec = codec or codec_arrays(fit_codec(vectors, bits))
    coarse = _ranked(_candidates(vectors, queries, max(k, rerank_k), codec, bits), ["coarse"], max(k, rerank_k)).drop("rank")
    return _ranked(coarse, ["distance"], k).select("qid", "id", "distance", "rank")


def recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """(queries, recall): the mean share of k that an answer shares with the exact one; the divisor is k at any size."""
    if k < 1:
        raise ValueError("k must be at least 1")
    shared = exact.select("qid", "id").join(approximate.select("qid", "id", F.lit(1).alias("_hit")), ["qid", "id"], "left")
    each = shared.groupBy("qid").agg(F.count("_hit").alias("_n"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("_n") / k), 9).alias("recall"))


def timed_evaluation(vectors: DataFrame, queries: DataFrame, k: int, rerank_k: int = 64, bits: int = 6) -> dict[str, float]:
    """recall of the quantised search, the 95th percentile of the milliseconds that a query takes by it and by the exact one,
    and their ratio. Queries are run one by one, as latencies are asked for: give few of them."""
    codec = codec_arrays(fit_codec(vectors, bits))
    times: dict[str, list[float]] = {"exact": [], "quantised": []}
    for row in queries.select("qid").orderBy("qid").toLocalIterator():
        one = queries.filter(F.col("qid") == row["qid"])
        for name, run in (("exact", lambda q: exact_nearest(vectors, q, k)), ("quantised", lambda q: quantised_nearest(vectors, q, k, rerank_k, bits, codec))):
            start = time.perf_counter()
            run(one).count()
            times[name].append(1000 * (time.perf_counter() - start))
    p95 = {name: sorted(t)[int((len(t) - 1) * 0.95)] if t else 0.0 for name, t in times.items()}
    found = recall(exact_nearest(vectors, queries, k), quantised_nearest(vectors, queries, k, rerank_k, bits, codec), k).first()["recall"]
    return {"recall": found, "exact_p95_ms": p95["exact"], "quantised_p95_ms": p95["quantised"], "ratio": p95["exact"] / p95["quantised"] if p95["quantised"] else 0.0}


def block_ids(vectors: DataFrame, block: int = 64) -> DataFrame:
    """(id, block_id): vectors in blocks of so many positions, positions being ids that count from 0."""
    return vectors.select("id", F.floor(F.col("id") / max(1, block)).alias("block_id"))


def read_order(blocks: DataFrame, batch: int = 16, group: int = 1_000_000) -> DataFrame:
    """(id, block_id, pos, batch): reads by block and id, in batches; positions are counted in ranges of blocks."""
    if batch < 1:
        raise ValueError("a batch must hold at least 1 read")
    ranged = blocks.withColumn("_g", F.floor(F.col("block_id") / group))
    before = ranged.groupBy("_g").agg(F.count("*").alias("_n"))
    offsets = before.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("_g").orderBy("block_id", "id")) - 1
    placed = ranged.withColumn("_within", within).join(F.broadcast(offsets.select("_g", "_before")), "_g")  # a row for each million blocks
    return placed.withColumn("pos", F.col("_before") + F.col("_within")).select("id", "block_id", "pos", F.floor(F.col("pos") / batch).alias("batch"))


def merged_reads(blocks: DataFrame, group: int = 1_000_000) -> DataFrame:
    """(ops): how many runs of equal or consecutive blocks the reads make; 0 without reads.

    Only different blocks are ordered, in ranges of so many; a run goes on over a range's edge.
    """
    different = blocks.select("block_id").distinct().withColumn("_g", F.floor(F.col("block_id") / group))
    gap = F.col("block_id") - F.lag("block_id").over(W.partitionBy("_g").orderBy("block_id"))
    inner = different.withColumn("_gap", gap).groupBy("_g").agg(
        F.count_if(F.col("_gap") > 1).alias("_gaps"), F.min("block_id").alias("_least"), F.max("block_id").alias("_most")
    )
    edge = F.col("_least") - F.lag("_most").over(W.orderBy("_g"))
    return inner.withColumn("_edge", edge).agg(
        F.coalesce(F.sum("_gaps") + F.count_if((F.col("_edge") > 1) | F.col("_edge").isNull()), F.lit(0)).alias("ops")
    )


def projected(vectors: DataFrame, matrix: list[list[float]] | None = None) -> DataFrame:
    """(id, vector): vectors times a matrix, or as they are; a matrix of other dimensions is an error."""
    if matrix is None:
        return vectors.select("id", "vector")
    m = np.array(matrix, np.float32)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.asarray(batch.column(1).flatten(), np.float32)
            if len(points) != batch.num_rows * m.shape[1]:
                raise ValueError("dimensions differ")
            turned = points.reshape(-1, m.shape[1]).astype(np.float64) @ m.T.astype(np.float64)
            ends = pa.array(np.arange(0, turned.size + 1, m.shape[0]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(turned.astype(np.float32).ravel()))], ["id", "vector"])

    return vectors.select("id", F.col("vector").cast("array<float>")).mapInArrow(turn, "id bigint, vector array<float>")
