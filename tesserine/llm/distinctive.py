"""How characteristic a term is of a record: residual inverse document frequency times the term's count.

A term that falls on records at random, as often as it occurs in the collection, would be in a Poisson
number of them. Terms that gather in fewer records than that have a high residual; common terms have none.

Terms are counted where the texts lie, a row for each term and batch, which holds both the batch's share of the
collection's counts and the records with the term. Only records whose key stands in several rows are moved.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions.sizes import join_checked
from tesserine.session import write_table

# Fixed value: what a term is.
TERM = r"[A-Za-z_][A-Za-z0-9_]+"

_term = re.compile(TERM)
_COUNTED = "term string, df bigint, cf bigint, keys array<string>, tfs array<bigint>"


def _terms(text: str | None, symbol: str | None) -> Counter:
    return Counter(map(str.lower, _term.findall(f"{text or ''} {symbol or ''}")))


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A batch's terms with their sums, and the records with a text that hold them `least` times, from rows with keys of their own."""
    for batch in batches:
        df: Counter = Counter()
        cf: Counter = Counter()
        held: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for key, symbol, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _terms(text, symbol)
            df.update(found.keys())
            cf.update(found)
            if text:
                for term, n in found.items():
                    if n >= least:
                        keys, tfs = held[term]
                        keys.append(key)
                        tfs.append(n)
        none: tuple[list, list] = ([], [])
        lists = [held.get(t, none) for t in df]
        columns = [
            pa.array([*df], pa.string()), pa.array([*df.values()], pa.int64()), pa.array([cf[t] for t in df], pa.int64()),
            pa.array([k for k, _ in lists], pa.list_(pa.string())), pa.array([n for _, n in lists], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["term", "df", "cf", "keys", "tfs"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, term, n, tf) of each row: n occurrences, and as many in tf if the row has a text."""
    for batch in batches:
        rows = []
        for key, symbol, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(key, term, n, n if text else None) for term, n in _terms(text, symbol).items()]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["_key", "term", "n", "tf"])


def term_counts(records: DataFrame, key: str, text: str, symbol: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(statistics, occurrences) = (term, df, cf) over all keys; (term, keys, tfs) in parts, of keys with tf >= least.

    df counts keys, cf occurrences in distinct rows; the tf of a key with several texts is that of the text with most.
    """
    rows = records.select(
        F.col(key).cast("string").alias("_key"), F.col(symbol).cast("string").alias("_symbol"), F.col(text).cast("string").alias("_text")
    ).filter("_key IS NOT NULL")
    repeated = write_table(rows.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"), "repeated-keys")
    alone = join_checked(rows, repeated, "_key", "left_anti").mapInArrow(lambda batches: _count(batches, least), _COUNTED)
    several = join_checked(rows, repeated, "_key", "left_semi").dropDuplicates().mapInArrow(_each, "_key string, term string, n bigint, tf bigint")
    merged = several.groupBy("_key", "term").agg(F.sum("n").alias("cf"), F.max("tf").alias("tf"))
    kept = F.col("tf") >= least
    none = F.array()
    listed = merged.select(
        "term",
        F.lit(1).cast("bigint").alias("df"),
        "cf",
        F.when(kept, F.array("_key")).otherwise(none.cast("array<string>")).alias("keys"),
        F.when(kept, F.array("tf")).otherwise(none.cast("array<bigint>")).alias("tfs"),
    )
    counted = write_table(alone.unionByName(listed), "term-counts")
    statistics = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return statistics, counted.filter(F.size("keys") > 0).select("term", "keys", "tfs")


def residual(df, cf, records):
    """Observed less expected inverse document frequency, in bits; never below 0."""
    observed = -F.log2(df / records)
    expected = -F.log2(-F.expm1(-cf / records))
    return F.greatest(F.lit(0.0), observed - expected)


def _scored(occurrences: DataFrame, statistics: DataFrame, key: str, records: int) -> DataFrame:
    joined = occurrences.join(statistics, "term").select("term", "df", "cf", F.explode(F.arrays_zip("keys", "tfs")).alias("_at"))
    score = F.round(F.col("_at.tfs") * residual(F.col("df"), F.col("cf"), F.lit(records)), 6)
    return joined.select(F.col("_at.keys").alias(key), "term", F.col("_at.tfs").alias("tf"), "df", "cf", score.alias("score"))


def scores(records: DataFrame, key: str = "node_id", text: str = "chunk_text", symbol: str = "symbol") -> DataFrame:
    """(key, term, tf, df, cf, score) of every term of every record with a text.

    df and cf are counted over all records; the score is tf times the residual inverse document frequency.
    A null or empty text gives no row, but its symbol's terms count; rows with a null key are left out and count
    for nothing; ties keep equal scores; repeated rows count once; a key with several texts counts once, with the
    largest tf of a term. Texts of any length are read whole; other columns are not read, so their names may clash.
    """
    statistics, occurrences = term_counts(records, key, text, symbol)
    return _scored(occurrences, statistics, key, records.select(F.count_distinct(key)).first()[0])


def rare_terms(
    records: DataFrame,
    key: str = "node_id",
    text: str = "chunk_text",
    symbol: str = "symbol",
    least: int = 5,
    most: int = 3,
) -> DataFrame:
    """(key, term, tf, df, cf, score): terms that occur `least` times in a record and in at most `most` keys; same rules as scores()."""
    statistics, occurrences = term_counts(records, key, text, symbol, least)
    return _scored(occurrences, statistics.filter(F.col("df") <= most), key, records.select(F.count_distinct(key)).first()[0])
