"""Budgeted breadth-first search over neighbour lists, level by level for a batch of requests; versioned adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.functions.vector import distance
from tesserine.session import write_table


def neighbour_lists(nodes: DataFrame) -> DataFrame:
    """(src, ordinal, dst) of the neighbour lists of nodes (id, neighbors); unknown and null neighbours are left out."""
    listed = nodes.select(F.col("id").alias("src"), F.posexplode("neighbors").alias("ordinal", "dst")).filter("dst IS NOT NULL")
    return listed.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "ordinal", "dst")


def visit_order(nodes: DataFrame, requests: DataFrame, budget: str = "max_visit") -> DataFrame:
    """(request_id, pos, id): the order in which a first-in-first-out search visits nodes from each request's entry.

    nodes: (id, neighbors), ids unique; requests: (request_id, entry_id, and the budget's column), ids unique. At most
    the budget is visited, however many nodes a worker takes at once. A null, negative or unknown entry, or a
    budget below 1, visits nothing. A request is one row, whose lists the budget bounds; each level joins the frontiers'
    neighbour lists, and is written, so lineage stays short; requests leave when they have nothing more to visit.
    """
    lists = neighbour_lists(nodes).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "dst"))).alias("_l"))
    known = write_table(lists.select("id", F.col("_l.dst").alias("_next")), "graph-lists")
    asked = requests.select("request_id", F.col("entry_id").alias("id"), F.col(budget).cast("int").alias("_budget")).filter("_budget > 0")
    entries = asked.join(nodes.select("id"), "id", "left_semi").select("request_id", "_budget", F.array("id").alias("_visited"), F.array("id").alias("_frontier"))
    level = write_table(entries, "graph-level")
    finished = level.filter("size(_visited) >= _budget")
    empty = F.array().cast(level.schema["_visited"].dataType)
    while True:
        going = level.filter("size(_visited) < _budget AND size(_frontier) > 0")
        if going.isEmpty():
            break
        step = going.select("request_id", F.posexplode("_frontier").alias("_at", "id")).join(known, "id")
        reached = step.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_next"))).alias("_all"))  # at most the budget's lists
        met = F.array_distinct(F.flatten(F.col("_all._next")))
        new = F.slice(F.array_except(F.coalesce(met, empty), "_visited"), F.lit(1), F.col("_budget") - F.size("_visited"))
        placed = going.select("request_id", "_budget", "_visited").join(reached, "request_id", "left").withColumn("_frontier", new)
        level = write_table(placed.select("request_id", "_budget", F.concat("_visited", "_frontier").alias("_visited"), "_frontier"), "graph-level")
        finished = finished.unionByName(level.filter("size(_visited) >= _budget OR size(_frontier) = 0"))
    return finished.select("request_id", F.posexplode("_visited").alias("pos", "id")).select("request_id", F.col("pos").cast("bigint").alias("pos"), "id")


def search(visited: DataFrame, nodes: DataFrame, requests: DataFrame, passes: Column) -> DataFrame:
    """(request_id, id, distance, rank): of the visited nodes that pass the filter, the top_k nearest to the query.

    Filtered nodes were visited and led on all the same. Ties go to the earlier visit. A query or embedding
    that is null takes no part; different lengths are as far as can be; a null top_k or one below 1 gives none.
    """
    vectors = nodes.select("id", "embedding").filter("embedding IS NOT NULL")
    asked = requests.select("request_id", "query", "top_k").filter("query IS NOT NULL")
    measured = visited.filter(passes).join(vectors, "id").join(asked, "request_id")
    scored = measured.select("request_id", "id", "pos", "top_k", distance(F.col("query"), F.col("embedding")).alias("distance"))
    order = W.partitionBy("request_id").orderBy("distance", "pos")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= top_k").select("request_id", "id", "distance", "rank")


def passing(nodes: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows of nodes that a bitmap (id, pass) lets through: those it does not name, and those whose value is 1."""
    values = bitmap.groupBy("id").agg(F.max(F.col("pass") == 1).alias("_pass"))
    return nodes.join(values, "id", "left").filter(F.coalesce("_pass", F.lit(True))).drop("_pass")


def search_stats(visited: DataFrame, passes: Column) -> DataFrame:
    """(request_id, visited, filtered_nodes): how many nodes each request visited, and how many of them fail the filter."""
    return visited.groupBy("request_id").agg(F.count("*").alias("visited"), F.count_if(~passes).alias("filtered_nodes"))


def latest(log: DataFrame) -> DataFrame:
    """(node_id, version, neighbors): each node's newest row of an append-only adjacency log."""
    return log.groupBy("node_id").agg(F.max_by("neighbors", "version").alias("neighbors"), F.max("version").alias("version")).select("node_id", "version", "neighbors")


def with_neighbours(log: DataFrame, updates: DataFrame) -> DataFrame:
    """The log with new neighbour lists (node_id, neighbors) appended under the next version; unknown ids are ignored."""
    current = latest(log).select("node_id", "version")
    new = updates.join(current, "node_id").select("node_id", (F.col("version") + 1).alias("version"), "neighbors")
    return log.select("node_id", "version", "neighbors").unionByName(new)


def bumped(log: DataFrame, touched: DataFrame) -> DataFrame:
    """The log with the same lists under the next version for touched (node_id); unknown ids are ignored."""
    return with_neighbours(log, latest(log).join(touched.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "neighbors"))


def validated(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node_id, version, valid): reads (node_id, version) that still have the same version afterwards."""
    now = after.select("node_id", F.col("version").alias("_now"))
    return before.select("node_id", "version").join(now, "node_id", "left").select("node_id", "version", F.col("_now").eqNullSafe(F.col("version")).alias("valid"))


def settled(readings: list[DataFrame]) -> DataFrame:
    """(node_id, version, neighbors): each node as the first reading gives it whose version the next reading still has.

    readings: a log as it was at one time after another, (node_id, version, neighbors) each. A node that changed between
    every two of them is left out. One reading is taken as it is.
    """
    if len(readings) == 1:
        return latest(readings[0])
    now = [latest(r) for r in readings]
    found = None
    for attempt, (before, after) in enumerate(zip(now, now[1:], strict=False)):
        held = before.join(after.select("node_id", "version"), ["node_id", "version"], "left_semi").withColumn("_attempt", F.lit(attempt))
        found = held if found is None else found.unionByName(held)
    first = found.groupBy("node_id").agg(F.min_by(F.struct("version", "neighbors"), "_attempt").alias("_r"))
    return first.select("node_id", "_r.version", "_r.neighbors")


def traverse(log: DataFrame, entries: DataFrame, max_steps: int, later: list[DataFrame] | None = None) -> DataFrame:
    """(request_id, pos, id): first-in-first-out traversal of at most max_steps nodes over consistent readings of a log.

    later: the log as it was read again after each attempt; a node that changed during all attempts is skipped.
    """
    nodes = settled([log, *(later or [])]).select(F.col("node_id").alias("id"), "neighbors")
    return visit_order(nodes, entries.withColumn("max_visit", F.lit(max_steps)))
