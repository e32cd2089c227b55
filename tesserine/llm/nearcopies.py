"""Groups of records that share most of their word shingles, by bottom-k sketches from one hash function.

Each text's distinct runs of words are hashed; the k smallest hashes are its sketch. Records with equal
shingle sets become one class. Inverted lists of the sketches' values generate overlaps of classes; the k smallest
values of both sketches together, the union's sketch, estimate the similarity and filter them; the exact Jaccard
similarity verifies what is left.

A sketch value in very many classes (common code) generates too many overlaps. Each class leaves only so many of
its most common values out of the lists that two similar sketches still meet at a rarer one. What may be lost are
pairs whose union's sketch holds fewer common values than is asked for: see `LOSS`. A list of n classes is still
n * n / 2 comparisons, also where it is long: it is cut into blocks that meet each other as tasks of their own, and a
pair is made once.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.functions.sizes import join_checked
from tesserine.session import write_table

#: Values in a sketch. At a similarity of 0.6 two sketches share 19 of 32 in the mean.
SKETCH = 32
#: A value in more classes than this is common.
COMMON = 64
#: Classes in a block of a common value's list.
LIST = 1024
#: Shingles aimed at in a block of sets that are compared with another block's.
COMPARED = 262_144
#: Probability that the sketches of a pair at just the least similarity share fewer values than are asked for.
LOSS = 1e-5

#: Words whose hashes a worker remembers at most, and bytes of the longest.
REMEMBERED, LONGEST = 131_072, 64

#: Bytes of words, in lower case; all others, also those of other letters in UTF-8, become blanks.
_lowered = bytes(ord(chr(c).lower()) if chr(c) in string.ascii_letters + string.digits + "_" else 32 for c in range(256))


class _Words(dict):
    """Hashes of words, remembered from text to text."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


_words = _Words()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of `words` consecutive words."""
    lower = (text if text.isascii() else text.lower()) if text else ""  # lower() makes ASCII of some other letters
    found = lower.encode("utf-8", "surrogatepass").translate(_lowered).split()
    if len(found) < words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    mixed = np.zeros(len(ids) - words + 1, np.uint64)
    for i in range(words):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += ids[i : len(ids) - words + 1 + i]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    first = np.ones(len(mixed), bool)
    np.not_equal(mixed[1:], mixed[:-1], out=first[1:])
    return mixed[first]


def sketches(records: DataFrame, words: int = 5, keep: int = SKETCH) -> DataFrame:
    """(_key, rep, size, sketch) of each row (_key, _text); texts without a shingle give no row.

    rep is a 64-bit hash of the whole set of shingles, alike for texts with the same set. A sketch's values are
    moved into the range of signed numbers, so that their order stays.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, reps, sizes, flat, ends = [], [], [], [], [0]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingle_hashes(t, words)
                if len(hashes) and k is not None:
                    keys.append(k)
                    reps.append(set_hash(hashes))
                    sizes.append(len(hashes))
                    flat.append((hashes[:keep] ^ np.uint64(1 << 63)).view(np.int64))
                    ends.append(ends[-1] + len(flat[-1]))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(reps, pa.int64()), pa.array(sizes, pa.int32()), found], ["_key", "rep", "size", "sketch"]
            )

    return records.mapInArrow(sketch, "_key string, rep bigint, size int, sketch array<bigint>")


def set_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of hashes."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sure_overlap(similarity: float) -> int:
    """Values that two full sketches at the similarity share but for a probability of LOSS.

    Of the least values of the union, one sketch's worth, both sets hold binomially many.
    """
    below, least = 0.0, 0
    while least < SKETCH and (below := below + math.comb(SKETCH, least) * similarity**least * (1 - similarity) ** (SKETCH - least)) <= LOSS:
        least += 1
    return max(1, least)


def overlaps(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of classes whose sketches overlap enough to verify; classes: (rep, size, sketch), a written table.

    How many classes hold a value is counted before values are moved; values of one class end there.
    """
    values = classes.select("rep", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("_n")).filter("_n > 1")
    held = values.join(counts, "value").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("_n", "value"))).alias("_held"))  # at most a sketch
    sizes = classes.select("rep", "size", F.size("sketch").alias("kept"))
    rare = F.filter("_held", lambda x: x["_n"] <= COMMON)
    common = F.filter("_held", lambda x: x["_n"] > COMMON)
    lists = write_table(held.join(sizes, "rep").select("rep", "size", "kept", rare.getField("value").alias("rare"), common.alias("common")), "lists")
    entries = lists.select("rep", "size", "kept", F.size("common").alias("common"), F.explode("rare").alias("value"))
    left, right = (entries.select("value", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "size", "kept", "common")]) for side in "ab")
    shared = (
        left.join(right, "value")
        .filter((F.col("rep_a") < F.col("rep_b")) & _allowed(similarity))
        .groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        .agg(F.count("*").alias("_shared"), F.first(F.greatest("kept_a", "kept_b")).alias("_kept"), F.first(F.least("common_a", "common_b")).alias("_common"))
        .filter(F.col("_shared") + F.col("_common") >= _needed(F.col("_kept"), similarity))
        .select("a", "b")
    )
    pairs = shared.unionByName(_common_overlaps(lists.filter(F.size("common") > 0), similarity)).distinct()
    sketch_a, sketch_b = (classes.select(F.col("rep").alias(side), F.col("sketch").alias(f"_sketch_{side}")) for side in "ab")
    return pairs.join(sketch_a, "a").join(sketch_b, "b").filter(_alike(F.col("_sketch_a"), F.col("_sketch_b"), similarity)).select("a", "b")


def _allowed(similarity: float) -> Column:
    """Whether sets of such sizes can be similar."""
    return F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b")


def _needed(kept: Column, similarity: float) -> Column:
    """Values that a sketch of so many shares with any other at the similarity; small sets are all in their sketches."""
    return F.least(F.lit(sure_overlap(similarity)), F.ceil(F.lit(similarity) * kept - 1e-9)).cast("int")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether the union's sketch holds enough values of both; a union smaller than a sketch is known whole.

    Both are sorted, so a value's place in the union follows from its places in them and among those that both hold.
    """
    both, least = F.array_intersect(a, b), sure_overlap(similarity)
    union = F.size(a) + F.size(b) - F.size(both)
    last = F.get(both, F.lit(least - 1))
    held = F.coalesce(F.array_position(a, last) + F.array_position(b, last) - least <= SKETCH, F.lit(False))
    return F.when(union < SKETCH, F.size(both) >= F.ceil(F.lit(similarity) * union - 1e-9)).otherwise(held)


def _common_overlaps(lists: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes that share enough common values; lists: (rep, size, kept, common), the rarest first.

    Where two sketches must share n values, the rarest that they share is in neither's n - 1 most common, so
    those are not listed. A pair is made at that value only. A long list is cut into blocks, of which each two meet.
    """
    listed = F.slice("common", F.lit(1), F.greatest(F.lit(0), F.size("common") - _needed(F.col("kept"), similarity) + 1))
    entries = lists.select("rep", "size", "kept", F.col("common.value").alias("values"), F.explode(listed).alias("_at"))
    blocks = F.ceil(F.col("_at._n") / LIST).cast("int")
    placed = entries.select("rep", "size", "kept", "values", F.col("_at.value").alias("value"), blocks.alias("_blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("_own"))
    columns = ("rep", "size", "kept", "values")
    left, right = (placed.select("value", "_own", "_blocks", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    left = left.withColumnRenamed("_own", "_i").withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_blocks") - 1))).drop("_blocks")
    right = right.withColumnRenamed("_own", "_j").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j")))).drop("_blocks")
    both = F.array_intersect("values_a", "values_b")
    enough = F.size(both) >= _needed(F.greatest("kept_a", "kept_b"), similarity)
    once = (F.col("_i") < F.col("_j")) | (F.col("rep_a") < F.col("rep_b"))
    pairs = left.join(right, ["value", "_i", "_j"]).filter(once & _allowed(similarity))
    made = pairs.filter(enough & (F.element_at(both, 1) == F.col("value")))
    return made.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def verified(pairs: DataFrame, records: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose exact similarity reaches the threshold.

    records: (_key, _text); classes: (rep, key, size); pairs and classes are written tables. Only the texts of one
    record of each paired class are moved. Classes are in blocks, and pairs are compared where their two blocks meet,
    so that a set moves once for each block that it has pairs in, however many pairs these are.
    """
    wanted = write_table(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(classes.select("rep", "key", "size"), "rep"), "paired")
    total = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(4, math.ceil(total / COMPARED))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, sets = [], []
            for text in batch.column(0).to_pylist():
                hashes = shingle_hashes(text, words)
                if len(hashes):
                    contents.append(set_hash(hashes))
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(contents, pa.int64()), pa.array(sets, pa.binary())], ["rep", "hashes"])

    keys = wanted.select(F.col("key").alias("_key")).distinct()
    texts = join_checked(records, keys, "_key", "left_semi", 50_000)
    sets = (
        texts.select("_text")
        .mapInArrow(hashed, "rep bigint, hashes binary")
        .join(wanted.select("rep"), "rep", "left_semi")
        .dropDuplicates(["rep"])
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {r: np.frombuffer(h, np.uint64) for r, h in zip(right.column("rep").to_pylist(), right.column("hashes").to_pylist(), strict=True)}
        a, b, jaccard = [], [], []
        for x, y in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            u, v = sorted((held[x], held[y]), key=len)
            both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
            j = both / (len(u) + len(v) - both)
            if j >= similarity:
                a.append(x)
                b.append(y)
                jaccard.append(j)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(jaccard, pa.float64())], ["a", "b", "jaccard"])

    block_a, block_b = (F.pmod(F.xxhash64(side), F.lit(blocks)) for side in "ab")
    placed = pairs.select("a", "b", (F.least(block_a, block_b) * blocks + F.greatest(block_a, block_b)).alias("_meeting"))
    moved = placed.select(F.col("_meeting").alias("_to"), F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets, "rep")
    return placed.groupBy("_meeting").cogroup(moved.groupBy("_to")).applyInArrow(compare, "a bigint, b bigint, jaccard double")


def similar_classes(
    records: DataFrame, key: str = "node_id", text: str = "chunk_text", words: int = 5, similarity: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """(members, links): (_key, rep) of each record with a shingle, and (a, b, jaccard) of similar classes.

    A class is all records with the same set of shingles; its rep is the set's hash. Words are the
    lower-cased runs of ASCII letters, digits and underscore. Null, empty and short texts are in no class;
    repeated rows count once; a key with several texts may be in several classes; rows with a null key are
    left out. Whole texts are read; other columns are not, so their names may clash.
    """
    rows = records.select(F.col(key).cast("string").alias("_key"), F.col(text).cast("string").alias("_text"))
    sketched = write_table(sketches(rows, words), "sketches")
    grouped = sketched.groupBy("rep").agg(F.min("_key").alias("key"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = write_table(grouped, "classes")
    members = sketched.select("_key", "rep").distinct()
    pairs = write_table(overlaps(classes, similarity), "overlaps")
    return members, verified(pairs, rows, classes, words, similarity)


def linked_members(records: DataFrame, key: str = "node_id", text: str = "chunk_text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, class_id, links): each record's class of equal shingle sets, and how many other classes are similar to it."""
    members, links = similar_classes(records, key, text, words, similarity)
    counts = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(counts, "rep", "left").select(F.col("_key").alias(key), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_pairs(records: DataFrame, key: str = "node_id", text: str = "chunk_text", words: int = 3, similarity: float = 0.6) -> DataFrame:
    """(key_a, key_b): pairs of distinct keys whose texts are similar, smaller key first; copies included."""
    members, links = similar_classes(records, key, text, words, similarity)
    left = members.select(F.col("rep").alias("a"), F.col("_key").alias("_a"))
    right = members.select(F.col("rep").alias("b"), F.col("_key").alias("_b"))
    across = links.select("a", "b").join(left, "a").join(right, "b")
    within = left.withColumnRenamed("a", "rep").join(right.withColumnRenamed("b", "rep"), "rep").filter("_a < _b")
    pairs = across.select("_a", "_b").unionByName(within.select("_a", "_b")).filter("_a <> _b")
    return pairs.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b")).distinct()
