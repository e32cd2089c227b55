"""What changed between full snapshots of a table, by an index of keys and hashes of the snapshot before.

The index holds one key and one hash for each record of the last snapshot, in buckets by key, whose number follows
the snapshot's size. A new snapshot's rows are moved to the buckets once and probe the index where it lies; one job
writes the next index and, apart from it, the changes, and the index is swapped to it. Old values are fetched for
changed keys only.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.sizes import join_checked
from tesserine.functions.text import normal_digest, normal_path
from tesserine.session import drop_path, new_path, write_table

#: Records aimed at in a bucket.
BUCKET = 200_000


class SnapshotIndex:
    """An index of keys and hashes that is probed by one full snapshot after another."""

    def __init__(self, spark: SparkSession, key: str, bucket: int = BUCKET) -> None:
        self.spark, self.key, self.bucket = spark, key, bucket
        self.buckets = 0
        self._generation: tuple[str, str] | None = None

    def _store(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Write a generation in buckets by key, into the shared folder, swap to it, and give its changes."""
        name, path = f"snapshot_index_{uuid.uuid4().hex}", new_path(self.spark, "snapshot-index")
        rows = rows.withColumn("_changed", F.col("change_kind").isNotNull())
        if buckets != self.buckets:
            rows = rows.repartition(buckets, self.key)
        rows.write.partitionBy("_changed").bucketBy(buckets, self.key).sortBy(self.key).option("path", path).saveAsTable(name)
        self._forget()
        self._generation, self.buckets = (name, path), buckets
        return self.spark.read.schema(rows.schema).parquet(path).filter("_changed").drop("_changed")

    def _forget(self) -> None:
        """Delete the generation's rows without a change; its changes stay readable."""
        if self._generation:
            self.spark.sql(f"DROP TABLE {self._generation[0]}")
            drop_path(self.spark, f"{self._generation[1]}/_changed=false")
            self._generation = None

    def probe(self, snapshot: DataFrame, first: bool = False, size: int | None = None) -> DataFrame:
        """(key, hash, present, change_kind) of the records that a snapshot of (key, hash) adds, removes or changes.

        Keys must be unique in a snapshot, which is counted first unless its size is given. A null hash means that the record
        is as it was: it takes over the indexed hash. change_kind is added, removed or changed; a record whose hash was
        never known is not changed when it becomes known. With `first`, the first snapshot has no changes.
        """
        key = self.key
        new = snapshot.select(F.col(key), F.col("hash").alias("_new"), F.lit(True).alias("_here"))
        buckets = max(1, math.ceil((new.count() if size is None else size) / self.bucket))
        if self._generation is None:
            rows = new.select(key, F.col("_new").alias("hash"), F.lit(True).alias("present"), F.when(~F.lit(first), F.lit("added")).alias("change_kind"))
            return self._store(rows, buckets)
        old = self.spark.table(self._generation[0]).filter("present").select(key, F.col("hash").alias("_old"), F.lit(True).alias("_there"))
        joined = new.repartition(self.buckets, key).join(old, key, "full_outer")
        kind = (
            F.when(F.col("_there").isNull(), "added")
            .when(F.col("_here").isNull(), "removed")
            .when(F.col("_new") != F.col("_old"), "changed")
        )
        return self._store(
            joined.select(key, F.coalesce("_new", "_old").alias("hash"), F.coalesce("_here", F.lit(False)).alias("present"), kind.alias("change_kind")), buckets
        )

    def close(self) -> None:
        """Delete the index; the changes it gave stay readable."""
        self._forget()


def ordered_versions(versions: DataFrame) -> list[str]:
    """Labels in the order of their instants; repeated labels count by the earliest, labels without one are left out.

    The list of versions is small: a row for each delivered snapshot.
    """
    instant = F.try_to_timestamp(F.col("created_at"))
    rows = versions.filter("version IS NOT NULL").groupBy("version").agg(F.min(instant).alias("at")).filter("at IS NOT NULL")
    return [r["version"] for r in rows.orderBy("at", "version").collect()]


def current_rows(manifest: DataFrame, versions: list[str]) -> DataFrame:
    """(version, file_path, digest): the row loaded last for each listed version and file, spellings made one.

    Ties on loaded_at go to the larger digest; rows without a version or path are left out.
    """
    rows = manifest.select(
        "version", normal_path(F.col("file_path")).alias("file_path"), normal_digest(F.col("digest")).alias("digest"), F.col("loaded_at").alias("_at")
    ).filter(F.col("version").isin(versions) & F.col("file_path").isNotNull() & (F.col("file_path") != ""))
    last = rows.groupBy("version", "file_path").agg(F.max(F.struct("_at", "digest")).alias("_last"))
    return last.select("version", "file_path", F.col("_last.digest").alias("digest"))


def manifest_changes(manifest: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, file_path, change_kind, old_digest): files added, removed or changed since the version before.

    old_digest is what the version before lists, null for added files and where it lists none. Rows belong to their
    version whenever they arrive; rows of unlisted versions are not read; the first version has no changes;
    repeated rows count once; empty tables give no rows. Extra columns are not read.
    """
    spark = manifest.sparkSession
    labels = ordered_versions(versions)
    rows = write_table(current_rows(manifest, labels), "current-rows", "version")
    sizes = {r["version"]: r["n"] for r in rows.groupBy("version").agg(F.count("*").alias("n")).collect()}  # a row a version
    index = SnapshotIndex(spark, "file_path")
    changes = spark.createDataFrame([], "version string, file_path string, change_kind string")
    for number, label in enumerate(labels):
        hashed = F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).alias("hash")
        found = index.probe(rows.filter(F.col("version") == label).select("file_path", hashed), True, sizes.get(label, 0))
        if number:
            changes = changes.unionByName(found.select(F.lit(label).alias("version"), "file_path", "change_kind"))
    index.close()
    before = spark.createDataFrame(list(zip(labels[1:], labels, strict=False)), "version string, _before string")
    olds = rows.select(F.col("version").alias("_before"), "file_path", "digest")
    return with_old_values(changes.join(F.broadcast(before), "version"), olds, "_before", "file_path").drop("_before")  # a row a version


def with_old_values(changes: DataFrame, before: DataFrame, *key: str) -> DataFrame:
    """changes joined with what the snapshot before held for their keys, as old_ columns; nothing else is fetched.

    Keys of both must be unique. Few changes are taken to where the old rows lie; many meet them by key.
    """
    keys = changes.filter("change_kind <> 'added'").select(*key)
    fetched = join_checked(before, keys, list(key), "left_semi")
    return changes.join(fetched.select(*key, *[F.col(c).alias(f"old_{c}") for c in before.columns if c not in key]), list(key), "left")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, status) between two manifests (file_path, digest): changed (new or different) or deleted.

    A null digest in the new manifest means that the file is there as it was.
    """
    here = new.select("file_path", F.col("digest").alias("_new"), F.lit(True).alias("_here"))
    there = old.select("file_path", F.col("digest").alias("_old"), F.lit(True).alias("_there"))
    differs = F.col("_there").isNull() | F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    status = F.when(F.col("_here").isNull(), "deleted").when(differs, "changed")
    return here.join(there, "file_path", "full_outer").select("file_path", status.alias("status")).filter("status IS NOT NULL")


def merged(retained: DataFrame, diff: DataFrame, ingested: DataFrame) -> DataFrame:
    """Chunks of unchanged files and the newly ingested ones."""
    kept = retained.join(diff.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(ingested)
