"""Hybrid retrieval for a batch of queries: dense, sparse, symbol and graph routes, fused by rank and reranked.

Nodes are chunks (node_id, module, file_path, symbol, language, chunk_text, neighbors); queries are (query_id, text,
module_scope, language, symbol_hint, graph_hops). Queries are a stated set: they meet the nodes in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.functions.sizes import meet_in_place
from tesserine.functions.text import SLOTS, expand, searchable, tokens
from tesserine.session import write_table

# Fixed values of the scores.
K1, B = 1.2, 0.75
FUSION = 60
HINT_BONUS = 0.05
EXACT, PREFIX, PART = 1.0, 0.85, 0.7
RERANK = {"fused": 0.6, "lexical": 0.35, "symbol": 0.2, "length_most": 0.2, "length_unit": 2000.0}

#: Queries of a block, and nodes of a part, that meet in one task; nodes that are scored at once.
QUERY_BLOCK, NODE_PART, STEP = 10_000, 50_000, 512
ROUTES = ("dense", "sparse", "symbol", "graph")


def distinct_nodes(chunks: DataFrame) -> DataFrame:
    """Chunks with an id, each id once."""
    return chunks.filter("node_id IS NOT NULL").dropDuplicates(["node_id"])


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Queries with an id, each id once; a null text is empty."""
    return queries.filter("query_id IS NOT NULL").dropDuplicates(["query_id"]).withColumn("text", F.coalesce("text", F.lit("")))


def top(scored: DataFrame, route: str, top_k: int) -> DataFrame:
    """(query_id, route, node_id, score, rank) of each query's best nodes; ties go to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select("query_id", F.lit(route).alias("route"), "node_id", "score", "rank")


def allowed(module: Column, language: Column, scope: Column, wanted: Column) -> Column:
    """Whether a node passes a query's scope and language; null and "" ask for nothing."""
    in_scope = F.coalesce(scope, F.lit("")).eqNullSafe("") | F.coalesce(F.contains(F.lower(module), F.lower(scope)), F.lit(False))
    in_language = F.coalesce(wanted, F.lit("")).eqNullSafe("") | F.coalesce(F.lower(language) == F.lower(wanted), F.lit(False))
    return in_scope & in_language


def node_tokens(nodes: DataFrame) -> DataFrame:
    """(node_id, module, language, words) of each node's searchable text."""
    return nodes.select("node_id", "module", "language", tokens(searchable(*map(F.col, ("module", "file_path", "symbol", "chunk_text")))).alias("words"))


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node_id, tf, dl, module, language): how often each token stands in each node, and the node's length."""
    words = node_tokens(nodes).withColumn("dl", F.size("words")).select("node_id", "module", "language", "dl", F.explode("words").alias("token"))
    return words.groupBy("token", "node_id").agg(F.count("*").alias("tf"), *[F.first(c).alias(c) for c in ("dl", "module", "language")])


def document_frequencies(inverted: DataFrame) -> DataFrame:
    """(token, df) over all nodes."""
    return inverted.groupBy("token").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    """The inverse document frequency of a token in df of n nodes."""
    return F.log((n + 1) / (df + 1)) + 1


def average_length(nodes: DataFrame) -> DataFrame:
    """(nodes, avg_len): how many nodes there are and their mean length in tokens, 1.0 where there is none."""
    return node_tokens(nodes).agg(F.count("*").alias("nodes"), F.coalesce(F.avg(F.size("words")), F.lit(1.0)).alias("avg_len"))


def counted_words(nodes: DataFrame) -> DataFrame:
    """Each node once, written, with its different words and how often they stand in it in place of its text.

    (node_id, module, language, symbol, neighbors, dl, words, times): words with spaces between them, times in their order,
    dl their sum. They are counted where the text is read, so texts are never moved. What has been counted is given back.
    """
    if "times" in nodes.columns:
        return nodes
    kept = ["node_id", "module", "language", "symbol", "neighbors"]
    words = tokens(searchable(*map(F.col, ("module", "file_path", "symbol", "chunk_text"))))
    rows = nodes.filter("node_id IS NOT NULL").select(*kept, words.alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("words")
            lengths = pc.list_value_length(held)
            coded = held.flatten().dictionary_encode()
            n = max(1, len(coded.dictionary))
            both, times = np.unique(np.repeat(np.arange(len(held)), lengths.to_numpy()) * n + coded.indices.to_numpy(), return_counts=True)
            offsets = pa.array(np.searchsorted(both // n, np.arange(len(held) + 1)), pa.int32())
            words, times = (pa.ListArray.from_arrays(offsets, x) for x in (coded.dictionary.take(pa.array(both % n)), pa.array(times, pa.int32())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lengths, pc.binary_join(words, " "), times], [*kept, "dl", "words", "times"])

    shape = "node_id string, module string, language string, symbol string, neighbors array<string>, dl int, words string, times array<int>"
    return write_table(rows.mapInArrow(count, shape).dropDuplicates(["node_id"]), "counted")


#: More than what rounding to 9 digits moves two scores.
NEAR = 2e-9
#: A word in one of so many nodes of a part is added up for all of them.
COMMON = 4


def sparse(nodes: DataFrame, queries: DataFrame, top_k: int = 8) -> DataFrame:
    """Hits by BM25 over the queries' own words; a repeated word counts again; only positive scores.

    Each part of the nodes, as counted words, meets a block of queries and keeps top_k of each query, so pairs of a query
    and a node are never moved.
    """
    nodes = counted_words(nodes)
    size = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_len")).first()  # two numbers
    average = float(size["avg_len"])
    wanted = [F.lower(F.coalesce(c, F.lit(""))).alias(to) for c, to in (("module_scope", "scope"), ("language", "wanted"))]
    asked = queries.select("query_id", *wanted, F.explode(tokens(F.col("text"))).alias("token"))
    asked = asked.groupBy("query_id", "scope", "wanted", "token").agg(F.count("*").alias("times"))
    asked = asked.join(document_frequencies(nodes.filter("dl > 0").select(F.explode(F.split("words", " ")).alias("token"))), "token")
    asked = asked.select("query_id", "scope", "wanted", F.col("token").alias("word"), (F.col("times") * idf(F.col("df"), F.lit(size["nodes"]))).alias("weight"))
    rows = nodes.filter("dl > 0").select("node_id", F.lower("module").alias("module"), F.lower("language").alias("language"), "dl", "words", "times")

    def score(held: pa.Table, asking: pa.Table) -> pa.Table:
        order = pc.sort_indices(held.column("node_id"))
        ids, modules, languages = (held.column(c).take(order) for c in ("node_id", "module", "language"))
        modules, languages = modules.to_pylist(), languages.to_pylist()
        place = np.argsort(order.to_numpy()).astype(np.int32)  # earlier ones have smaller ids
        words = pc.unique(asking.column("word"))
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))]
        for first in range(0, len(held), STEP):  # a few at once, of which only words that are asked for stay
            step = held.slice(first, STEP).combine_chunks()
            times = step.column("times")
            word = pc.index_in(pc.list_flatten(pc.split_pattern(step.column("words"), " ")), words)
            asked_for = word.is_valid().to_numpy()
            row = np.repeat(np.arange(len(step)), pc.list_value_length(times).to_numpy())[asked_for]
            tf = pc.list_flatten(times).to_numpy()[asked_for].astype(np.float64)
            found.append((word.drop_null().to_numpy(), place[first + row], tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * step.column("dl").to_numpy()[row] / average))))
        word, node, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        node, value, starts = node[order], value[order], np.searchsorted(word[order], np.arange(len(words) + 1))
        common = {w: np.bincount(node[starts[w] : starts[w + 1]], value[starts[w] : starts[w + 1]], len(ids)) for w in np.flatnonzero(np.diff(starts) * COMMON > len(ids))}
        asking = asking.sort_by([(c, "ascending") for c in ("scope", "wanted", "query_id", "word")])
        at, weight = pc.index_in(asking.column("word"), words).to_numpy(), asking.column("weight").to_numpy()
        queries = asking.column("query_id").to_numpy()
        begins = np.flatnonzero(np.append(True, queries[1:] != queries[:-1])[: len(queries)])
        filters = zip(*(asking.column(c).take(pa.array(begins)).to_pylist() for c in ("scope", "wanted")), strict=True)
        last, passing = ("", ""), None
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first, end, given in zip(begins, np.append(begins[1:], len(queries)), filters, strict=True):
            if given != last:
                last, (scope, language) = given, given
                passing = np.array([scope in (m or "") and (not language or language == x) for m, x in zip(modules, languages, strict=True)], np.float64)
            scores = np.zeros(len(ids))
            for w, part in zip(at[first:end], weight[first:end], strict=True):
                if w in common:
                    scores += part * common[w]
                else:
                    reach = slice(starts[w], starts[w + 1])
                    scores[node[reach]] += part * value[reach]
            if passing is not None:
                scores *= passing
            least = np.partition(scores, -top_k)[-top_k] - NEAR if len(ids) > top_k else 0.0
            found = np.flatnonzero(scores > max(least, 0.0))
            rounded = np.round(scores[found], 9)
            best = np.argsort(-rounded, kind="stable")[:top_k]
            out.append((np.full(len(best), queries[first]), found[best], rounded[best]))
        asked_by, places, rounded = (np.concatenate([np.empty(0, t), *x]).astype(t) for x, t in zip(zip(*out, strict=True) if out else ((), (), ()), (np.int64, np.int64, np.float64), strict=True))
        return pa.table([pa.array(asked_by), ids.take(pa.array(places)), pa.array(rounded)], ["query_id", "node_id", "score"]).filter(pa.array(rounded > 0))

    found = meet_in_place(rows, asked, "query_id", score, "query_id bigint, node_id string, score double", NODE_PART, 20 * QUERY_BLOCK, (nodes, queries))
    return top(found, "sparse", top_k)


def _coded(rows: DataFrame) -> DataFrame:
    """The rows with the counts of their words' slots, as bytes, in place of the words."""
    kept = [c for c in rows.columns if c != "words"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, int] = {}
        for batch in batches:
            out = []
            for words in batch.column("words").to_pylist():
                counts = np.zeros(SLOTS, np.float32)
                for w in words:
                    slot = slots.get(w)
                    if slot is None:
                        slot = slots[w] = hashlib.sha1(w.encode()).digest()[0]
                    counts[slot] += 1
                out.append(counts.tobytes())
            if len(slots) > 500_000:
                slots.clear()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "counts"])

    shape = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c != "words")
    return rows.mapInArrow(code, f"{shape}, counts binary")


def _slotted(rows: DataFrame) -> DataFrame:
    """The same of counted words."""
    kept = [c for c in rows.columns if c not in ("words", "times")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column("times")
            coded = pc.split_pattern(batch.column("words"), " ").flatten().dictionary_encode()
            slots = np.array([hashlib.sha1(w.encode()).digest()[0] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            empty = pc.equal(batch.column("words"), "").to_numpy(zero_copy_only=False)
            slots = slots[np.repeat(~empty, np.maximum(1, pc.list_value_length(times).to_numpy()))]
            at = np.repeat(np.arange(len(times)), pc.list_value_length(times).to_numpy()) * SLOTS + slots
            counts = np.bincount(at, times.flatten().to_numpy(), len(times) * SLOTS).astype(np.float32).reshape(-1, SLOTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([c.tobytes() for c in counts], pa.binary())], [*kept, "counts"])

    shape = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in kept)
    return rows.mapInArrow(code, f"{shape}, counts binary")


def _counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a table's rows, and their lengths."""
    matrix = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.float32).reshape(-1, SLOTS).astype(np.float64)
    return matrix, np.sqrt((matrix**2).sum(1))


#: More than what single precision and rounding move a cosine.
SINGLE = 1e-5


def _unit(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts as vectors of length 1 in single precision; those of length 0 stay."""
    return (counts / np.where(lengths > 0, lengths, 1.0)[:, None]).astype(np.float32)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def dense(nodes: DataFrame, queries: DataFrame, top_k: int = 8) -> DataFrame:
    """Hits by the cosine of hashed word counts; queries are expanded; nodes without a common word stay, with score 0.

    Each part of the nodes meets a block of queries as matrix products and keeps top_k of each query, so what is
    moved then is top_k rows for a query and part.
    """
    nodes = counted_words(nodes)
    rows = _slotted(nodes.select("node_id", *(F.lower(c).alias(c) for c in ("module", "language", "symbol")), "words", "times"))
    wanted = [F.lower(F.coalesce(c, F.lit(""))).alias(to) for c, to in (("module_scope", "scope"), ("language", "wanted"), ("symbol_hint", "hint"))]
    asked = _coded(queries.select("query_id", *wanted, expand(tokens(F.col("text"))).alias("words")))

    def score(held: pa.Table, asking: pa.Table) -> pa.Table:
        held = held.take(pa.array(np.argsort(np.array(held.column("node_id").to_pylist(), object), kind="stable")))
        matrix, norms = _counts(asking)
        unit = _unit(matrix, norms)
        by_value = []
        for c in ("scope", "wanted", "hint"):
            values = asking.column(c).to_pylist()
            members: dict[str, list[int]] = {}
            for i, v in enumerate(values):
                if v:
                    members.setdefault(v, []).append(i)
            by_value.append({v: np.array(x) for v, x in members.items()})
        best = np.full((len(matrix), top_k), -np.inf)
        at = np.zeros((len(matrix), top_k), np.int64)
        for first in range(0, len(held), STEP) if len(matrix) else ():
            step = held.slice(first, STEP)
            counts, lengths = _counts(step)
            near = unit @ _unit(counts, lengths).T  # in single precision, to tell which scores are needed
            for column, groups, kind in zip(("module", "language", "symbol"), by_value, ("scope", "wanted", "hint"), strict=True):
                values = [v or "" for v in step.column(column).to_pylist()]
                for value, members in groups.items():
                    if kind == "hint":
                        if fitting := [i for i, v in enumerate(values) if value in v]:
                            near[np.ix_(members, fitting)] += HINT_BONUS
                    else:
                        near[np.ix_(members, [i for i, v in enumerate(values) if not (value in v if kind == "scope" else value == v)])] = -np.inf
            least, margin = best[:, -1], np.where((norms > 0) | (first == 0), SINGLE, 0.0)
            if len(step) > top_k:
                least = np.maximum(least, np.partition(near, -top_k, 1)[:, -top_k]) if first == 0 else least
            row, column = np.nonzero((near > (least - margin).astype(np.float32)[:, None]) & (near > -np.inf))
            with np.errstate(divide="ignore", invalid="ignore"):
                exact = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", matrix[row[i : i + 10_000]], counts[column[i : i + 10_000]]) for i in range(0, len(row), 10_000))]) / (norms[row] * lengths[column])
            exact[~np.isfinite(exact)] = 0.0
            exact = np.round(exact, 9) + np.where(near[row, column] - exact > HINT_BONUS / 2, HINT_BONUS, 0.0)
            better = exact > best[row, -1]
            row, column, exact = row[better], column[better], exact[better]
            changed = np.unique(row)
            by = np.concatenate([np.repeat(changed, top_k), row])
            scores, places = np.concatenate([best[changed].ravel(), exact]), np.concatenate([at[changed].ravel(), first + column])
            order = np.lexsort((places, -scores, by))  # of equal ones the earlier first, with smaller ids
            begins = np.searchsorted(by[order], changed)
            kept = order[(begins[:, None] + np.arange(top_k)).ravel()].reshape(-1, top_k)
            best[changed], at[changed] = scores[kept], places[kept]
        keep = np.isfinite(best)
        ids = np.repeat(asking.column("query_id").to_numpy(), keep.sum(1))
        return pa.table([pa.array(ids, pa.int64()), held.column("node_id").take(pa.array(at[keep])), pa.array(np.round(best[keep], 9))], ["query_id", "node_id", "score"])

    found = meet_in_place(rows, asked, "query_id", score, "query_id bigint, node_id string, score double", NODE_PART, QUERY_BLOCK, (nodes, queries))
    return top(found, "dense", top_k)


def symbol_hint(query_text: Column, hint: Column) -> Column:
    """What the symbol route looks for: the hint, else the first word ending in service or index; "" for nothing."""
    given = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    fitting = F.filter(tokens(query_text), lambda w: w.endswith("service") | w.endswith("index"))
    return F.when(given != "", given).otherwise(F.coalesce(F.get(fitting, 0), F.lit("")))


def symbol(nodes: DataFrame, queries: DataFrame, top_k: int = 8) -> DataFrame:
    """Hits whose symbol equals, begins with or holds the hint. An automaton of a block of hints reads each symbol once."""
    asked = queries.withColumn("_hint", symbol_hint(F.col("text"), F.col("symbol_hint"))).filter("_hint <> ''")
    names = nodes.filter("symbol IS NOT NULL").select(F.lower("symbol").alias("_symbol")).distinct()

    def match(held: pa.Table, asking: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for h in asking.column("_asked").to_pylist():
            automaton.add_word(h, h)
        automaton.make_automaton()
        found = [(n, h) for n in held.column("_symbol").to_pylist() for h in {h for _, h in automaton.iter(n)}] if len(asking) else []
        scores = [EXACT if n == h else PREFIX if n.startswith(h) else PART for n, h in found]
        return pa.table([pa.array([n for n, _ in found], pa.string()), pa.array([h for _, h in found], pa.string()), pa.array(scores, pa.float64())], ["_symbol", "_hint", "score"])

    matched = meet_in_place(names, asked.select(F.col("_hint").alias("_asked")).distinct(), "_asked", match, "_symbol string, _hint string, score double", 4 * NODE_PART, QUERY_BLOCK)
    wanted = asked.select("query_id", "module_scope", F.col("language").alias("_wanted"), "_hint")
    held = nodes.select("node_id", "module", "language", F.lower("symbol").alias("_symbol"))
    scored = matched.join(wanted, "_hint").join(held, "_symbol").filter(allowed(F.col("module"), F.col("language"), F.col("module_scope"), F.col("_wanted")))
    return top(scored.select("query_id", "node_id", "score"), "symbol", top_k)


def undirected(nodes: DataFrame) -> DataFrame:
    """(src, dst): the edges of the nodes' neighbour lists, both ways, without repeats."""
    forth = nodes.select(F.col("node_id").alias("src"), F.explode("neighbors").alias("dst")).filter("dst IS NOT NULL")
    return forth.unionByName(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


#: Hits of a route that the graph route starts from.
SEEDS = 3


def seeds(by_name: DataFrame, by_words: DataFrame) -> DataFrame:
    """(query_id, node_id): the symbol route's best three, or where it has none the dense route's."""
    named = by_name.filter(F.col("rank") <= SEEDS).select("query_id", "node_id")
    others = by_words.filter(F.col("rank") <= SEEDS).join(named.select("query_id").distinct(), "query_id", "left_anti")
    return named.unionByName(others.select("query_id", "node_id"))


def within_hops(edges: DataFrame, starts: DataFrame, hops: Column, most: int) -> DataFrame:
    """(query_id, node_id, depth): nodes within each query's hops of its starts, at their least depth.

    starts: (query_id, node_id) and what the column `hops` reads; most: the largest number of hops. Each level
    is one join and is written, so that the next one reads it and lineage stays short.
    """
    edges = write_table(edges, "edges")
    level = write_table(starts.select("query_id", "node_id", hops.alias("_hops")).distinct().withColumn("depth", F.lit(0)), "hops")
    reached = level
    for depth in range(1, most + 1):
        step = level.filter(F.col("_hops") >= depth).join(edges.withColumnRenamed("src", "node_id"), "node_id").select("query_id", F.col("dst").alias("node_id"), "_hops")
        new = step.distinct().join(reached.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        level = write_table(new.withColumn("depth", F.lit(depth)), "hops")
        reached = reached.unionByName(level)
    return reached.select("query_id", "node_id", "depth")


def graph(nodes: DataFrame, queries: DataFrame, top_k: int = 8, starts: DataFrame | None = None) -> DataFrame:
    """Hits by hops from the seeds, 1 / (depth + 1); paths may pass nodes that the scope leaves out, and unknown ids."""
    starts = seeds(symbol(nodes, queries, SEEDS), dense(nodes, queries, SEEDS)) if starts is None else starts
    most = queries.agg(F.coalesce(F.max("graph_hops"), F.lit(0)).alias("m")).first()["m"]
    asked = queries.select("query_id", F.coalesce("graph_hops", F.lit(2)).alias("graph_hops"), "module_scope", F.col("language").alias("_wanted"))
    reached = within_hops(undirected(nodes), starts.join(asked, "query_id"), F.col("graph_hops"), max(most, 2))
    held = reached.join(nodes.select("node_id", "module", "language"), "node_id").join(asked, "query_id")
    held = held.filter(allowed(F.col("module"), F.col("language"), F.col("module_scope"), F.col("_wanted")))
    return top(held.select("query_id", "node_id", F.round(1 / (F.col("depth") + 1), 9).alias("score")), "graph", top_k)


def plan(queries: DataFrame) -> DataFrame:
    """(query_id, routes): dense and sparse, symbol where the query names one, and graph."""
    text = F.lower("text")
    hinted = F.coalesce("symbol_hint", F.lit("")) != ""
    named = hinted | F.contains(text, F.lit("::")) | F.contains(text, F.lit("(")) | F.contains(text, F.lit("service"))
    routes = F.when(named, F.array(*map(F.lit, ROUTES))).otherwise(F.array(*(F.lit(r) for r in ROUTES if r != "symbol")))
    return queries.select("query_id", routes.alias("routes"))


def route_hits(nodes: DataFrame, queries: DataFrame, top_k: int = 8, planned: DataFrame | None = None) -> DataFrame:
    """The hits of all planned routes in one table; the graph route starts from the others' hits.

    planned: (query_id, routes) in place of the built-in plan; it may leave routes out or add them.
    """
    nodes = counted_words(nodes)
    planned = (plan(queries) if planned is None else planned).select("query_id", F.explode("routes").alias("route"))
    most = max(top_k, SEEDS)
    by_words, by_name = write_table(dense(nodes, queries, most), "dense-hits"), write_table(symbol(nodes, queries, most), "symbol-hits")
    linked = graph(nodes, queries, top_k, seeds(by_name, by_words))
    every = _union([by_words, sparse(nodes, queries, top_k), by_name, linked]).filter(F.col("rank") <= top_k)
    return every.join(planned, ["query_id", "route"], "left_semi")


def fuse(hits: DataFrame, keep: int) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) over the routes, added in the routes' order."""
    parts = [F.coalesce(F.max(F.when(F.col("route") == r, 1 / (F.col("rank") + FUSION))), F.lit(0.0)) for r in ROUTES]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return top(hits.groupBy("query_id", "node_id").agg(F.round(total, 9).alias("score")), "rrf", keep)


def rerank(nodes: DataFrame, queries: DataFrame, fused: DataFrame, top_k: int = 8) -> DataFrame:
    """Order fused hits by the fused score, the share of query words they hold, the hint and their length."""
    nodes = counted_words(nodes)
    words = queries.select("query_id", "symbol_hint", F.array_distinct(tokens(F.col("text"))).alias("_words"))
    joined = fused.select("query_id", "node_id", F.col("score").alias("_fused")).join(words, "query_id").join(nodes.select("node_id", "symbol", "words", F.size("times").alias("_length")), "node_id")
    lexical = F.size(F.array_intersect("_words", F.split("words", " "))) / F.greatest(F.lit(1.0), F.size("_words").cast("double"))
    penalty = F.least(F.lit(RERANK["length_most"]), F.col("_length") / F.lit(RERANK["length_unit"]))
    hinted = (F.coalesce("symbol_hint", F.lit("")) != "") & F.coalesce(F.contains(F.lower("symbol"), F.lower("symbol_hint")), F.lit(False))
    score = F.lit(RERANK["fused"]) * F.col("_fused") + F.lit(RERANK["lexical"]) * lexical + F.when(hinted, RERANK["symbol"]).otherwise(0.0) - penalty
    return top(joined.select("query_id", "node_id", F.round(F.greatest(F.lit(0.0), score), 9).alias("score")), "rerank", top_k)


def retrieve(nodes: DataFrame, queries: DataFrame, top_k: int = 8, planned: DataFrame | None = None) -> dict[str, DataFrame]:
    """route_hits, fused_hits (twice top_k, of which a caller is shown top_k) and final_hits of a batch of queries."""
    nodes = counted_words(nodes)
    hits = write_table(route_hits(nodes, queries, top_k, planned), "route-hits")
    fused = write_table(fuse(hits, 2 * top_k), "fused-hits")
    return {"route_hits": hits, "fused_hits": fused, "final_hits": rerank(nodes, queries, fused, top_k)}


def evaluate(cases: DataFrame, final_hits: DataFrame) -> DataFrame:
    """(total, hit_at_5, mrr) of cases (name, query_id, expected_node_id) on final hits of at most five a query."""
    expected = cases.dropDuplicates()
    found = final_hits.filter("rank <= 5").select("query_id", F.col("node_id").alias("expected_node_id"), "rank")
    joined = expected.join(found, ["query_id", "expected_node_id"], "left")
    return joined.agg(
        F.count("*").alias("total"),
        F.round(F.coalesce(F.avg(F.col("rank").isNotNull().cast("int")), F.lit(0.0)), 9).alias("hit_at_5"),
        F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 9).alias("mrr"),
    )
