"""The most similar vectors of every vector, by low-dimensional stable projections indexed by kd-trees.

A Gaussian projection keeps a distance d as d times a chi variable, so a vector whose projected distance to
a query exceeds the chi quantile times the query's current k-th distance is no neighbour but with the small
probability LOSS. A kd-tree over the projections of a bounded sample divides all vectors into cells; a second
one divides each cell into leaves. Leaves are visited by increasing projected distance and their vectors verified
by exact distances until the chi-square test stops a query.

With the k-th distance found in its own cell, a query asks which other cells hold a vector that passes the test. For that
only projections meet, of more dimensions, as then hardly any vector passes that is no neighbour: blocks of cells in
leaves with tight boxes, and the queries that a block may concern. Whole vectors visit the few cells that remain.
Both meetings are split where very many queries come to one place.

Equal vectors are one class with its smallest ids, so a vector that very many rows share is no burden.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions.sizes import join_checked
from tesserine.session import write_table

#: Dimensions of the projection that trees are built on, and of the one that chooses the cells to visit.
PROJECTED, TESTED = 8, 32
#: Probability with which the stopping test, and the choice of cells, may lose a neighbour at just the k-th distance.
LOSS, TEST_LOSS = 0.01, 0.001
#: Vectors in the sample that the cells are fitted on, at most (a bound for the driver's memory), and for each cell.
SAMPLE, FITTED = 20_000, 16
#: Vectors aimed at in a cell, and held at most in a leaf; cells at most (a bound for the tree, which workers hold).
CELL, LEAF, CELLS = 16_384, 256, 1 << 20
#: Vectors aimed at in a block, and held at most in a leaf of it.
BLOCK, TIGHT = 1 << 20, 96
#: Queries that meet a block or a cell in one group, at least.
VISITORS = 16_384
#: Share of a node's sample, around its middle, in which a split may lie where fewer vectors are near.
MIDDLE = 0.3


def chi_square_quantile(share: float, dimensions: int) -> float:
    """The value below which a chi-square variable of so many dimensions lies with probability `share`."""

    def below(x: float) -> float:
        if dimensions % 2 == 0:
            return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
        tail = math.erfc(math.sqrt(x / 2))
        tail += math.exp(-x / 2) * sum((x / 2) ** (i + 0.5) / math.gamma(i + 1.5) for i in range(dimensions // 2))
        return 1 - tail

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


class Cells(NamedTuple):
    """A kd-tree: for each inner node its dimension, threshold and children; for each cell its box."""

    dimension: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def assign(self, projected: np.ndarray) -> np.ndarray:
        """The cell of each projected vector; children below 0 are cells, as -1 - cell."""
        if not len(self.dimension):
            return np.zeros(len(projected), np.int64)
        node = np.zeros(len(projected), np.int64)
        inner = np.ones(len(projected), bool)
        while inner.any():
            at = node[inner]
            side = projected[inner, self.dimension[at]] < self.threshold[at]
            node[inner] = np.where(side, self.left[at], self.right[at])
            inner = node >= 0
        return -1 - node


def fit_cells(sample: np.ndarray, cells: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Cells:
    """Split a projected sample, in a box, into so many cells, at thresholds near the middle with few vectors around."""
    dims = sample.shape[1]
    dimension, threshold, left, right = [], [], [], []
    lows, highs = [], []

    def split(rows: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int) -> int:
        if wanted <= 1 or len(rows) < 4:
            lows.append(low)
            highs.append(high)
            return -len(lows)
        best = (math.inf, 0, 0.0)
        for d in range(dims):
            values = np.sort(sample[rows, d])
            n = len(values)
            near = (values[-1] - values[0]) / 12 or 1.0
            tries = values[int(n * (0.5 - MIDDLE / 2)) : max(int(n * (0.5 + MIDDLE / 2)), int(n * (0.5 - MIDDLE / 2)) + 1)]
            tries = tries[:: max(1, len(tries) // 64)]
            around = np.searchsorted(values, tries + near) - np.searchsorted(values, tries - near)
            # a spread-out dimension has fewer vectors in a band of given width
            width = values[int(n * 0.9)] - values[int(n * 0.1)] or 1e-9
            cost = around / n / width
            i = int(np.argmin(cost))
            if cost[i] < best[0]:
                best = (cost[i], d, float(tries[i]))
        _, d, at = best
        below = sample[rows, d] < at
        if below.all() or not below.any():
            lows.append(low)
            highs.append(high)
            return -len(lows)
        node = len(dimension)
        dimension.append(d)
        threshold.append(at)
        left.append(0)
        right.append(0)
        share = max(1, min(wanted - 1, round(wanted * below.mean())))
        upper, lower = high.copy(), low.copy()
        upper[d] = lower[d] = at
        left[node] = split(rows[below], low, upper, share)
        right[node] = split(rows[~below], lower, high, wanted - share)
        return node

    whole = np.full(dims, np.inf)
    split(np.arange(len(sample)), -whole if low is None else low, whole if high is None else high, cells)
    kinds = (np.int64, np.float64, np.int64, np.int64)
    return Cells(*(np.array(x, kind) for x, kind in zip((dimension, threshold, left, right), kinds, strict=True)), np.array(lows), np.array(highs))


def grafted(top: Cells, parts: dict[int, Cells]) -> Cells:
    """The tree whose cells are divided further by trees of their own."""
    dimension, threshold, left, right = (list(x) for x in top[:4])
    lows, highs = [], []
    places = {}
    for cell in range(len(top.low)):
        part = parts.get(cell)
        if part is None or not len(part.dimension):
            lows.append(top.low[cell])
            highs.append(top.high[cell])
            places[-1 - cell] = -len(lows)
            continue
        node, first = len(dimension), len(lows)
        places[-1 - cell] = node
        dimension.extend(part.dimension)
        threshold.extend(part.threshold)
        for to, children in ((left, part.left), (right, part.right)):
            to.extend(np.where(children < 0, children - first, children + node))
        lows.extend(part.low)
        highs.extend(part.high)
    for to in (left, right):
        for i in range(len(top.dimension)):
            to[i] = places.get(to[i], to[i])
    kinds = (np.int64, np.float64, np.int64, np.int64)
    return Cells(*(np.array(x, kind) for x, kind in zip((dimension, threshold, left, right), kinds, strict=True)), np.array(lows), np.array(highs))


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, as (points, boxes)."""
    points, low, high = (np.asarray(x, np.float32) for x in (points, low, high))
    total = np.zeros((len(points), len(low)), np.float32)
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        gap = low[:, d] - x
        np.maximum(gap, x - high[:, d], out=gap)
        np.maximum(gap, 0, out=gap)
        gap *= gap
        total += gap
    return total


def leaves(projected: np.ndarray, most: int = 0) -> list[np.ndarray]:
    """Rows of each leaf, of at most so many, of a kd-tree over projected vectors."""
    out, stack = [], [np.arange(len(projected))]
    while stack:
        rows = stack.pop()
        if len(rows) <= (most or LEAF):
            out.append(rows)
            continue
        values = projected[rows]
        d = int(np.argmax(values.max(0) - values.min(0)))
        half = len(rows) // 2
        order = np.argpartition(values[:, d], half)
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


def tight_leaves(projected: np.ndarray, most: int) -> list[np.ndarray]:
    """The same, split at the widest gap near the middle, so that groups stay whole and boxes small."""
    out, stack = [], [np.arange(len(projected))] if len(projected) else []
    while stack:
        rows = stack.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        values = projected[rows]
        values = values[:, int(np.argmax(values.var(0)))]
        order = np.argsort(values, kind="stable")
        first, last = len(rows) // 5, len(rows) - len(rows) // 5
        at = first + int(np.argmax(np.diff(values[order])[first:last])) + 1
        stack += [rows[order[:at]], rows[order[at:]]]
    return out


def cells_to_visit(queries: np.ndarray, home: np.ndarray, bounds: np.ndarray, points: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell): the cells, other than the home one, that hold a point within a query's bound by the projected test."""
    few = min(PROJECTED, queries.shape[1])
    factor, coarse = (chi_square_quantile(1 - TEST_LOSS, d) for d in (queries.shape[1], few))
    groups = []
    for cell in np.unique(cells):
        held = np.flatnonzero(cells == cell)
        groups += [(cell, held[g]) for g in tight_leaves(points[held], TIGHT)]
    if not groups or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.array([c for c, _ in groups])
    low = np.array([points[g].min(0) for _, g in groups])
    high = np.array([points[g].max(0) for _, g in groups])
    norms = (points**2).sum(1)
    limits = factor * bounds.astype(np.float64) ** 2 * 1.001 + 1e-3
    asked_q, asked_c = [], []
    # queries with alike bounds together, as wide ones ask many leaves
    by_bound = np.argsort(bounds, kind="stable")
    for part in np.array_split(by_bound, max(1, math.ceil(len(queries) / (8 * LEAF)))):
        for block in tight_leaves(queries[part], 2 * TIGHT):
            rows = part[block]
            q = queries[rows]
            norm, limit = (q**2).sum(1), limits[rows]
            # the leaves that the block as a whole may ask, then those that a query may by few dimensions, then by all
            between = np.maximum(np.maximum(low - q.max(0), q.min(0) - high), 0)
            near = np.flatnonzero((between * between).sum(1) <= limit.max())
            open_ = box_distances(q[:, :few], low[near, :few], high[near, :few]) <= limit[:, None] * (coarse / factor)
            open_ &= owner[near] != home[rows][:, None]
            several = open_.any(0)
            near, open_ = near[several], open_[:, several]
            open_ &= box_distances(q, low[near], high[near]) <= limit[:, None]
            found: set[tuple[int, int]] = set()
            for i in np.flatnonzero(open_.any(0)):
                cell, g = groups[near[i]]
                asking = np.flatnonzero(open_[:, i])
                d = norm[asking, None] + norms[g] - 2 * (q[asking] @ points[g].T)
                found.update((int(x), int(cell)) for x in asking[(d <= limit[asking, None]).any(1)])
            asked_q.extend(rows[i] for i, _ in found)
            asked_c.extend(c for _, c in found)
    return np.array(asked_q, np.int64), np.array(asked_c, np.int64)


def search(queries: np.ndarray, bounds: np.ndarray, points: np.ndarray, matrix: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, rows) of up to `keep` points nearest to each query within its bound; infinite where there are fewer."""
    found = np.full((len(queries), keep), np.inf)
    rows = np.full((len(queries), keep), -1, np.int64)
    if not len(queries) or not len(points):
        return found, rows
    low_q, low_p = queries @ matrix, points @ matrix
    factor = chi_square_quantile(1 - LOSS, matrix.shape[1])
    groups = leaves(low_p)
    low = np.array([low_p[g].min(0) for g in groups])
    high = np.array([low_p[g].max(0) for g in groups])
    blocks = [(g, points[g], (points[g] ** 2).sum(1)) for g in groups]
    for block in leaves(low_q):
        q = queries[block]
        norm = (q**2).sum(1)
        near = box_distances(low_q[block], low, high)
        best = np.full((len(block), keep), np.inf, np.float32)
        best_rows = np.full((len(block), keep), -1, np.int64)
        limit = (bounds[block] ** 2).astype(np.float64)
        for leaf in np.argsort(near.min(0)):
            asked = np.flatnonzero(near[:, leaf] <= factor * limit)
            if not len(asked):
                continue
            g, p, p_norm = blocks[leaf]
            d = np.maximum(norm[asked, None] + p_norm - 2 * (q[asked] @ p.T), 0)
            open_ = np.flatnonzero((d <= limit[asked, None] * 1.0001 + 1e-4).any(1))
            if not len(open_):
                continue
            asked, d = asked[open_], d[open_]
            both = np.concatenate([best[asked], d], 1)
            from_ = np.concatenate([best_rows[asked], np.broadcast_to(g, d.shape)], 1)
            least = np.argpartition(both, keep - 1, 1)[:, :keep]
            best[asked] = np.take_along_axis(both, least, 1)
            best_rows[asked] = np.take_along_axis(from_, least, 1)
            limit[asked] = np.minimum(limit[asked], best[asked].max(1) * 1.0001 + 1e-4)
        exact = np.where(best_rows >= 0, np.sqrt(((q[:, None, :].astype(np.float64) - points[best_rows]) ** 2).sum(2)), np.inf)
        order = np.argsort(exact, 1, kind="stable")
        found[block] = np.take_along_axis(exact, order, 1)
        rows[block] = np.take_along_axis(best_rows, order, 1)
    return found, rows


def _expand(found: np.ndarray, rows: np.ndarray, ids: list[np.ndarray], keep: int, radius: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each query the distances and ids of its nearest rows, classes taken apart; and its bound from now on."""
    distances, named = [], []
    bounds = np.full(len(found), radius)
    for i, (d, r) in enumerate(zip(found, rows, strict=True)):
        good = np.flatnonzero(d <= radius)
        parts = [ids[j] for j in r[good]]
        far = np.repeat(d[good], [len(p) for p in parts])
        all_ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        order = np.lexsort((all_ids, far))[:keep]
        distances.append(far[order])
        named.append(all_ids[order])
        if len(order) == keep:
            bounds[i] = far[order[-1]]
    return distances, named, bounds


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _matrix(values: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    joined = b"".join(values.to_pylist())
    return np.frombuffer(joined, np.float32).reshape(-1, dimensions)


def usable(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Rows whose vector has the right length and neither nulls nor NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return vectors.filter((F.size(vector) == dimensions) & ~bad)


class Neighbours(NamedTuple):
    """members: (id, vid, is_node); lists: (vid, near ARRAY<STRUCT<d, id>>), up to k + 1 nearest nodes, own ones included."""

    members: DataFrame
    lists: DataFrame


def _fitted(rows: DataFrame, total: int, matrix: np.ndarray) -> Cells:
    """The tree of cells for so many vectors, from a sample on the driver; where it can't carry them all, samples of
    its cells, each on a worker, divide these further."""
    dimensions = len(matrix)
    every = max(1, math.ceil(total / SAMPLE))
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * SAMPLE).select("vector").toArrow().column(0)
    flat = np.array(drawn.combine_chunks().flatten(), np.float32) if len(drawn) else np.empty(0, np.float32)
    wanted = min(CELLS, max(1, math.ceil(total / CELL)))
    top = fit_cells(flat.reshape(-1, dimensions) @ matrix, min(wanted, max(1, SAMPLE // FITTED)))
    if wanted * FITTED <= SAMPLE:
        return top
    each = math.ceil(wanted / len(top.low))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.asarray(batch.column(0).flatten(), np.float32).reshape(-1, dimensions) @ matrix
            yield pa.RecordBatch.from_arrays([pa.array(top.assign(low), pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())], ["cell", "low"])

    def fit(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        sample = _matrix(group.column("low"), matrix.shape[1])
        part = fit_cells(sample, each, top.low[cell], top.high[cell])
        return pa.table({"cell": pa.array([cell], pa.int64()), "tree": pa.array([pickle.dumps(tuple(part))], pa.binary())})

    share = max(1, total // (wanted * FITTED))
    sampled = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)) == 0).select("vector").mapInArrow(place, "cell bigint, low binary")
    trees = sampled.groupBy("cell").applyInArrow(fit, "cell bigint, tree binary").collect()  # at most CELLS nodes
    return grafted(top, {r["cell"]: Cells(*pickle.loads(r["tree"])) for r in trees})


def _chunked(rows: DataFrame, place: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a chunk, (place, _chunks)): rows that come to one place, in chunks of about so many."""
    counts = rows.groupBy(place).agg(F.ceil(F.count("*") / F.lit(least)).cast("int").alias("_chunks"))
    numbered = join_checked(rows, counts, place).withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("_chunks")).cast("int"))
    return numbered.drop("_chunks"), counts


def nearest(nodes: DataFrame, queries: DataFrame, k: int = 10, radius: float = math.inf, dimensions: int = 128, seed: int = 7) -> Neighbours:
    """The nodes nearest to each node and each query; nodes: (id, vector), queries: (id, vector), ids BIGINT.

    Rows with a null id, or a vector that is null, of a wrong length or with a null or NaN, are left out; repeated
    rows count once; ties go to the smaller id; empty tables give empty results. Distances are exact; a neighbour
    is lost with a probability below LOSS + TEST_LOSS each. Other columns must not be given.
    """
    rows = usable(nodes.toDF("id", "vector").withColumn("is_node", F.lit(True)), "vector", dimensions)
    rows = rows.unionByName(usable(queries.toDF("id", "vector").withColumn("is_node", F.lit(False)), "vector", dimensions)).filter("id IS NOT NULL")
    rows = rows.select("id", F.col("vector").cast("array<float>").alias("vector"), "is_node").withColumn("vid", F.xxhash64("vector"))
    total = nodes.count() + queries.count()
    keep = k + 1
    whole_matrix = np.random.default_rng(seed).standard_normal((dimensions, max(PROJECTED, TESTED))).astype(np.float32)
    matrix = np.ascontiguousarray(whole_matrix[:, :PROJECTED])
    cells = _fitted(rows, total, matrix)
    count = len(cells.low)
    blocks = max(1, min(count, math.ceil(total / BLOCK)))
    edges = [b * count // blocks for b in range(blocks)]
    block_low, block_high = np.minimum.reduceat(cells.low, edges), np.maximum.reduceat(cells.high, edges)
    used = np.flatnonzero(np.isfinite(cells.low).any(0) | np.isfinite(cells.high).any(0))
    split_factor = chi_square_quantile(1 - TEST_LOSS, len(used)) if len(used) else 0.0
    tree = cells._replace(low=None, high=None)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each distinct vector of a batch, with its cell and smallest node ids."""
        for batch in batches:
            vid = batch.column("vid").to_numpy()
            if not len(vid):
                continue
            vectors = np.asarray(batch.column("vector").flatten(), np.float32).reshape(-1, dimensions)
            ids, node = batch.column("id").to_numpy(), batch.column("is_node").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, ~node, vid))
            starts = np.flatnonzero(np.r_[True, vid[order][1:] != vid[order][:-1]])
            ends = np.r_[starts[1:], len(order)]
            named = []
            for s, e in zip(starts, ends, strict=True):
                group = order[s:e]
                named.append(np.unique(ids[group[node[group]]])[:keep])
            first = order[starts]
            own = vectors[first] + np.float32(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tree.assign(own @ matrix), pa.int64()),
                    pa.array(vid[first]),
                    pa.array([v.tobytes() for v in own], pa.binary()),
                    _lists(named, pa.int64()),
                ],
                ["cell", "vid", "vector", "ids"],
            )

    points = write_table(rows.mapInArrow(place, "cell bigint, vid bigint, vector binary, ids array<bigint>"), "points")

    def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """A cell's distinct vectors with their smallest node ids."""
        vid = group.column("vid").to_numpy()
        order = np.argsort(vid, kind="stable")
        starts = np.flatnonzero(np.r_[True, vid[order][1:] != vid[order][:-1]]) if len(vid) else np.empty(0, np.int64)
        listed = group.column("ids").to_pylist()
        ends = np.r_[starts[1:], len(order)] if len(vid) else starts
        ids = [np.unique(np.concatenate([np.array(listed[j], np.int64) for j in order[s:e]]))[:keep] for s, e in zip(starts, ends, strict=True)]
        first = order[starts]
        return vid[first], _matrix(group.column("vector").take(pa.array(first)), dimensions), ids

    answer = "vid bigint, cell bigint, block int, held boolean, low binary, bound double, d array<double>, id array<bigint>"

    def at_home(group: pa.Table) -> pa.Table:
        """Answers of a cell's vectors from the cell, with their projections, and a row for each block they have to ask."""
        vid, vectors, ids = merged(group)
        home = group.column("cell")[0].as_py()
        has = np.array([len(i) > 0 for i in ids], bool)
        held = np.flatnonzero(has)
        found, at = search(vectors, np.full(len(vectors), radius), vectors[held], matrix, keep)
        d, named, bounds = _expand(found, np.where(at >= 0, held[at], -1) if len(held) else at, ids, keep, radius)
        low = (vectors @ whole_matrix[:, :TESTED]).astype(np.float16)
        flat = [x.tobytes() for x in low]
        asks, asked = np.empty(0, np.int64), np.empty(0, np.int64)
        if count > 1:
            gaps = box_distances((vectors @ matrix)[:, used], block_low[:, used], block_high[:, used])
            with np.errstate(invalid="ignore"):
                asks, asked = np.nonzero(gaps <= split_factor * bounds[:, None] ** 2)
        n, m = len(vid), len(asks)
        own = int(np.searchsorted(edges, home, "right")) - 1
        columns = [
            pa.array(np.r_[vid, vid[asks]], pa.int64()),
            pa.array(np.full(n + m, home), pa.int64()),
            pa.array(np.r_[np.full(n, own), asked], pa.int32()),
            pa.array([*has.tolist(), *[None] * m], pa.bool_()),
            pa.array([*flat, *(flat[i] for i in asks)], pa.binary()),
            pa.array(np.r_[bounds, bounds[asks]], pa.float64()),
            _lists([*d, *[np.empty(0)] * m], pa.float64()),
            _lists([*named, *[np.empty(0, np.int64)] * m], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in answer.split(", ")])

    def choose(block: pa.Table, asking: pa.Table) -> pa.Table:
        """The cells of a block that queries have to visit."""
        decode = lambda t: np.frombuffer(b"".join(t.column("low").to_pylist()), np.float16).reshape(-1, TESTED).astype(np.float32)
        home, bounds = asking.column("cell").to_numpy(), asking.column("bound").to_numpy()
        q, c = cells_to_visit(decode(asking), home, bounds, decode(block), block.column("cell").to_numpy())
        return pa.table([pa.array(c, pa.int64()), asking.column("vid").take(pa.array(q)), asking.column("bound").take(pa.array(q))], ["cell", "vid", "bound"])

    def abroad(group: pa.Table, visitors: pa.Table) -> pa.Table:
        """Answers of visiting vectors from a cell."""
        if not len(group) or not len(visitors):
            return pa.Table.from_arrays([pa.array([], f) for f in (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))], ["vid", "d", "id"])
        _, vectors, ids = merged(group)
        asked, first = np.unique(visitors.column("vid").to_numpy(), return_index=True)
        bounds = visitors.column("bound").to_numpy()[first]
        found, at = search(_matrix(visitors.column("vector").take(pa.array(first)), dimensions), bounds, vectors, matrix, keep)
        d, named, _ = _expand(found, at, ids, keep, radius)
        full = [i for i, n in enumerate(named) if len(n)]
        return pa.Table.from_arrays(
            [pa.array(asked[full], pa.int64()), _lists([d[i] for i in full], pa.float64()), _lists([named[i] for i in full], pa.int64())], ["vid", "d", "id"]
        )

    home = write_table(points.groupBy("cell").applyInArrow(at_home, answer), "home-answers")
    pair = F.arrays_zip("d", "id").alias("near")
    lists = home.filter("held IS NOT NULL").select("vid", pair)
    if count > 1:
        asking, numbers = _chunked(home.filter("held IS NULL").select("vid", "cell", "block", "low", "bound").toDF("vid", "cell", "block", "low", "bound"), "block", max(VISITORS, min(total, BLOCK) // 8))
        held = join_checked(home.filter("held").select("cell", "block", "low"), numbers, "block")
        held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
        chosen = held.groupBy("block", "chunk").cogroup(asking.groupBy("block", "chunk")).applyInArrow(choose, "cell bigint, vid bigint, bound double")
        visits, numbers = _chunked(write_table(chosen, "visits"), "cell", VISITORS)
        visits = visits.join(points.select("vid", "vector").toDF("vid", "vector"), "vid")
        held = join_checked(points.filter(F.size("ids") > 0), numbers, "cell")
        held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
        away = held.groupBy("cell", "chunk").cogroup(visits.groupBy("cell", "chunk")).applyInArrow(abroad, "vid bigint, d array<double>, id array<bigint>")
        # at most k + 1 of each cell that a vector visits
        gathered = lists.unionByName(away.select("vid", pair)).groupBy("vid").agg(F.flatten(F.collect_list("near")).alias("near"))
        lists = gathered.select("vid", F.slice(F.array_sort("near"), 1, keep).alias("near"))
    members = rows.select("id", "vid", "is_node").distinct()
    return Neighbours(members, lists)


def neighbour_rows(found: Neighbours, k: int = 10) -> DataFrame:
    """(id, is_node, neighbour, rank, distance): up to k nearest nodes of each row, other than itself."""
    others = F.slice(F.filter("near", lambda x: (x["id"] != F.col("id")) | ~F.col("is_node")), 1, k)
    joined = found.members.join(found.lists, "vid").select("id", "is_node", F.posexplode(others).alias("rank", "n"))
    return joined.select("id", "is_node", F.col("n.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("n.d").alias("distance"))


def neighbour_pairs(found: Neighbours, k: int = 10) -> DataFrame:
    """(id_a, id_b): pairs of which one is a neighbour of the other, smaller id first."""
    rows = neighbour_rows(found, k)
    return rows.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
