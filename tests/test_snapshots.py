"""What changed between snapshots, by hand-made cases and against an independent SQL formulation."""

import datetime as dt

import duckdb
import pytest

from tesserine.operators import snapshots
from tesserine.plans.oracle import ORACLE
from tesserine.session import new_path, release, write_table
from tesserine.sources.store import SnapshotStore

MANIFEST = "version string, module string, file_path string, digest string, loaded_at timestamp_ntz, extra string"
T0 = dt.datetime(2025, 1, 1)


def rows(*values):
    return [(v, "m", p, d, T0 + dt.timedelta(minutes=t), "x") for v, p, d, t in values]


def versions(spark, *pairs):
    return spark.createDataFrame(list(pairs), "version string, created_at string")


def changes(spark, values, order):
    found = snapshots.manifest_changes(spark.createDataFrame(values, MANIFEST), versions(spark, *order))
    return sorted((r["version"], r["file_path"], r["change_kind"]) for r in found.collect())


ORDER = [("b", "2025-02-01T00:00:00+00:00"), ("a", "2025-01-31T20:00:00-05:00"), ("c", "2025-03-01T00:00:00Z"), ("b", "2025-02-01T00:00:00+00:00")]


def test_added_removed_changed_and_order_by_instant(spark):
    # b is 00:00 UTC, a is 01:00 UTC of the same day: b comes first
    values = rows(("b", "m/x.py", "1", 0), ("b", "m/y.py", "1", 0), ("a", "m/x.py", "2", 0), ("a", "m/z.py", "1", 0), ("c", "m/x.py", "2", 0), ("c", "m/z.py", "1", 0))
    assert changes(spark, values, ORDER) == [("a", "m/x.py", "changed"), ("a", "m/y.py", "removed"), ("a", "m/z.py", "added")]


def test_spellings_late_rows_repeats_nulls_and_unlisted(spark):
    values = rows(
        ("b", "./m//x.py", "AB", 0),
        ("b", "m\\x.py", "ab", 5),
        ("a", "m/x.py", None, 1),
        ("c", "m/x.py", "ab", 1),
        ("c", "m/x.py", "ab", 1),
        ("c", "m/late.py", "1", 9_999_999),
        ("zzz", "m/q.py", "1", 0),
        ("c", None, "1", 0),
    )
    assert changes(spark, values, ORDER) == [("c", "m/late.py", "added")]


def test_the_row_loaded_last_counts(spark):
    values = rows(("b", "m/x.py", "1", 0), ("a", "m/x.py", "9", 0), ("a", "m/x.py", "1", 1), ("c", "m/x.py", "1", 3), ("c", "m/x.py", "2", 4))
    assert changes(spark, values, ORDER) == [("c", "m/x.py", "changed")]


def test_null_takes_over_the_hash_before(spark):
    values = rows(("b", "m/x.py", "1", 0), ("a", "m/x.py", None, 0), ("c", "m/x.py", "2", 0))
    assert changes(spark, values, ORDER) == [("c", "m/x.py", "changed")]


def test_empty_tables(spark):
    assert changes(spark, [], ORDER) == []
    assert changes(spark, rows(("b", "m/x.py", "1", 0)), []) == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_against_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    found = snapshots.manifest_changes(spark.read.parquet(f"{folder}/manifest.parquet"), spark.read.parquet(f"{folder}/index_versions.parquet"))
    con = duckdb.connect()
    for name in ("manifest", "index_versions"):
        con.execute(f"create view {name} as from '{folder}/{name}.parquet'")
    want = con.execute(ORACLE["p6_found"]).fetchall()
    assert sorted(tuple(r) for r in found.select("version", "file_path", "change_kind").collect()) == sorted(want)


def test_old_values_are_fetched_for_changes_only(spark):
    before = spark.createDataFrame([("k1", "1"), ("k2", "2")], "k string, v string")
    found = snapshots.with_old_values(spark.createDataFrame([("k1", "changed")], "k string, change_kind string"), before, "k")
    assert [tuple(r) for r in found.collect()] == [("k1", "changed", "1")]


def test_old_digests(spark):
    values = rows(("b", "m/x.py", "1", 0), ("b", "m/y.py", "5", 0), ("a", "m/x.py", "2", 0), ("a", "m/z.py", "1", 0))
    found = snapshots.manifest_changes(spark.createDataFrame(values, MANIFEST), versions(spark, *ORDER[:2]))
    assert sorted((r["file_path"], r["old_digest"]) for r in found.collect()) == [("m/x.py", "1"), ("m/y.py", "5"), ("m/z.py", None)]


def test_buckets_follow_the_size(spark):
    index = snapshots.SnapshotIndex(spark, "k", bucket=10)
    counts, held = [], {}
    for size, step in ((5, 1), (45, 2), (23, 3)):
        now = {f"k{i}": i // step for i in range(size)}
        found = index.probe(spark.createDataFrame(list(now.items()), "k string, hash bigint"))
        want = {(k, "added") for k in now.keys() - held.keys()} | {(k, "removed") for k in held.keys() - now.keys()} | {(k, "changed") for k in now.keys() & held.keys() if now[k] != held[k]}
        assert {(r["k"], r["change_kind"]) for r in found.collect()} == want
        counts.append(index.buckets)
        held = now
    assert counts == [1, 5, 3]
    index.close()


def test_manifest_diff(spark):
    def manifest(**files):
        return spark.createDataFrame(list(files.items()), "file_path string, digest string")

    old, new = manifest(a="1", b="2"), manifest(a="1", b="3", c="4")
    assert sorted(tuple(r) for r in snapshots.manifest_diff(old, new).collect()) == [("b", "changed"), ("c", "changed")]
    assert [tuple(r) for r in snapshots.manifest_diff(old, manifest(a="1")).collect()] == [("b", "deleted")]


def test_store(spark):
    store = SnapshotStore(spark, new_path(spark, "store"))
    assert store.active_version() is None and store.load_active() is None
    nodes = spark.createDataFrame([("n", "p")], "node_id string, file_path string")
    manifest = spark.createDataFrame([("p", "1")], "file_path string, digest string")
    store.save("v1", nodes, manifest)
    before = store.load("v1")
    store.save("v1", nodes.union(nodes), manifest)
    assert before.nodes.count() == 1 and store.load("v1").nodes.count() == 2  # who reads the old data goes on
    store.save("v1", nodes, manifest)
    assert store.clean("v1") == 2
    store.activate("v0")
    store.activate("v1")
    loaded = store.load_active()
    assert loaded.version == "v1" and loaded.nodes.count() == 1 and loaded.manifest.count() == 1
    with pytest.raises(KeyError):
        store.load("v2")


def test_release_deletes_written_tables(spark):
    release(spark)
    kept = write_table(spark.range(3), "kept")
    assert kept.count() == 3 and release(spark) == 1 and release(spark) == 0
