"""The queries of this package's operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import boundaries, credentials, distinctive, nearcopies, neighbours, packing, provenance, tokenizer, truncation
from tesserine.session import write_table
from tesserine.sources.tables import table


#: Dimensions, neighbours and radius of problem 1.
DIMENSIONS, NEIGHBOURS, RADIUS = 128, 10, 1.8


def _nearest(spark: SparkSession, folder: str) -> neighbours.Neighbours:
    nodes = table(spark, folder, "graph_nodes").select("id", "embedding")
    requests = table(spark, folder, "search_requests").select("request_id", "query")
    return neighbours.nearest(nodes, requests, NEIGHBOURS, RADIUS, DIMENSIONS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of which one is among the 10 nearest nodes of the other."""
    return neighbours.neighbour_pairs(_nearest(spark, folder), NEIGHBOURS)


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest nodes of every node and request, with rank and distance."""
    return neighbours.neighbour_rows(_nearest(spark, folder), NEIGHBOURS)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that occur at least 5 times in a chunk and in at most 3 chunks."""
    return distinctive.rare_terms(table(spark, folder, "chunks")).select("node_id", "term")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's terms with counts and score."""
    return distinctive.scores(table(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are generated, minified, vendored or data."""
    return provenance.not_by_hand(table(spark, folder, "chunks")).select(F.col("_path").alias("file_path"))


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The same files with the reasons."""
    return provenance.not_by_hand(table(spark, folder, "chunks")).withColumnRenamed("_path", "file_path")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Natural lines to cut at, of chunks above 8,000 characters."""
    return boundaries.natural_lines(table(spark, folder, "chunks")).select(F.col("_key").alias("node_id"), "line_no")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Those chunks in pieces of at most 8,000 characters with 10 lines of overlap."""
    return boundaries.pieces(table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines at which a credential's value begins."""
    return credentials.credential_lines(table(spark, folder, "chunks"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with their credentials replaced."""
    return credentials.redacted(table(spark, folder, "chunks"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks that share at least 0.6 of their runs of three words."""
    return nearcopies.similar_pairs(table(spark, folder, "chunks"), words=3, similarity=0.6)


def p7_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's class of equal texts, and how many other classes are similar to it, by runs of five words and 0.8."""
    return nearcopies.linked_members(table(spark, folder, "chunks"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each piece of it, for every capacity."""
    sizes = write_table(tokenizer.token_counts(table(spark, folder, "documents"), "doc_id", "text"), "token-counts")
    return packing.pack_all(sizes, "doc_id", table(spark, folder, "containers"))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers each capacity takes, and how full they are."""
    packed = p9_packed(spark, folder).filter("tokens > 0")
    return packed.groupBy("container_id", "capacity").agg(
        F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("tokens")
    ).withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    rows = truncation.truncated(table(spark, folder, "documents"))
    return rows.filter("cut").select(F.col("_key").alias("doc_id")).distinct()


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each source, how many of its texts were cut."""
    return truncation.cut_shares(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbours, p2_found, p2_scores, p3_found, p3_kinds, p4_found, p4_pieces, p5_found, p5_redacted,
        p7_found, p7_members, p8_ids, p9_packed, p9_fill, p10_found, p10_shares,
    )
}
