"""A stream of files kept as an index: every micro-batch is merged into the active version and swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserine.operators.snapshots import manifest_diff, merged
from tesserine.session import write_table
from tesserine.sources.repository import ingest
from tesserine.sources.store import SnapshotStore


def merge_batch(store: SnapshotStore, files: DataFrame, batch: int, stream: str = "stream") -> None:
    """Merge (file_path, content), and sequence where there is one, into the active version, whoever made it.

    Of several rows of a path the one with the largest sequence counts, of those the larger content; without that
    column a path should stand once in a batch. Each version holds the last batch of each stream that is in it, so a
    batch is merged once, also when a stream starts again.
    """
    last = store.load_active()
    batches = dict(last.batches) if last else {}
    if batches.get(stream, -1) >= batch or files.isEmpty():
        return
    order = F.struct(F.col("sequence") if "sequence" in files.columns else F.lit(0), "content")
    rows = files.groupBy("file_path").agg(F.max_by("content", order).alias("content")).withColumn("digest", F.sha1("content"))
    rows = write_table(rows, "stream-files")
    nodes, manifest = ingest(rows.select("file_path", "content")), rows.select("file_path", "digest")
    if last is not None:
        diff = manifest_diff(last.manifest, manifest).filter("status = 'changed'")  # a batch brings files, it deletes none
        kept = last.manifest.join(manifest.select("file_path"), "file_path", "left_anti")
        nodes, manifest = merged(last.nodes, diff, ingest(rows.join(diff, "file_path", "left_semi").select("file_path", "content"))), kept.unionByName(manifest)
    version = f"{stream}-{batch:012d}"
    store.save(version, nodes, manifest, batches | {stream: batch})
    store.activate(version)


def index_stream(files: DataFrame, store: SnapshotStore, checkpoint: str, once: bool = True, stream: str = "stream") -> StreamingQuery:
    """Run merge_batch over a stream of files, known by a name; once: stop when what is there was read."""
    writer = files.writeStream.foreachBatch(lambda rows, batch: merge_batch(store, rows, batch, stream)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
