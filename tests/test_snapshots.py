"""Versions of a manifest: what is rewritten, what shuffles, what is read, and two writers at a time."""

import re
import threading

import pytest

from shelfmark.functions.paths import TOP
from shelfmark.operators import diff
from shelfmark.plans import jobs
from shelfmark.sources import snapshots
from shelfmark.sources.shared_dir import scratch
from shelfmark.streaming import jobs as streams

MANIFEST = "path string, name string, size long, modified long, etag string"


def manifest(spark, rows):
    return spark.createDataFrame([(p, p.rpartition("/")[2], 1, m, "e") for p, m in rows], MANIFEST)


def rows_of(spark, root, version=None):
    return sorted((r.path, r.modified) for r in snapshots.read_manifest(spark, root, version=version).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def shuffled(spark):
    """Joins that don't broadcast, whatever the size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_commit_writes_the_roots_that_it_touches(spark):
    root = scratch(spark, "m")
    assert snapshots.commit(spark, root, manifest(spark, [(f"/r{k}/f{n}", 1) for k in range(5) for n in range(20)] + [("/top", 1), ("/a=b'c/x", 1)])) == 0
    assert snapshots.commit(spark, root, manifest(spark, [("/r1/f3", 2), ("/r1/f3", 3), ("/r1/new", 1)]), manifest(spark, [("/r2/f0", 0), ("/r1/new", 0), ("/nowhere/x", 0)])) == 1
    first, second = (snapshots.Log(spark, root).entry(v)["roots"] for v in (0, 1))
    assert {r for r in second if first.get(r) != second[r]} == {"r1", "r2"} and "nowhere" not in second and TOP in second
    written = spark.read.parquet(f"{root}/data/{second['r1']}")
    assert {r.root for r in written.select("root").distinct().collect()} == {"r1", "r2"}
    want = {f"/r{k}/f{n}": 1 for k in range(5) for n in range(20)} | {"/top": 1, "/a=b'c/x": 1}
    assert rows_of(spark, root, 0) == sorted(want.items())
    want |= {"/r1/f3": 3, "/r1/new": 1}
    del want["/r2/f0"]
    assert rows_of(spark, root) == sorted(want.items())
    snapshots.commit(spark, root, deletes=manifest(spark, [(f"/r3/f{n}", 0) for n in range(20)]))
    assert "r3" not in snapshots.Log(spark, root).latest()[1]["roots"] and len(rows_of(spark, root)) == len(want) - 20
    assert snapshots.forget(spark, root, keep=1) > 0 and snapshots.versions(spark, root) == [2] and len(rows_of(spark, root)) == len(want) - 20


def test_joins_leave_the_snapshot_where_it_is(spark, shuffled):
    root = scratch(spark, "m")
    snapshots.commit(spark, root, manifest(spark, [(f"/r{k}/f{n}", 1) for k in range(3) for n in range(50)]))
    base, other = snapshots.read_manifest(spark, root), manifest(spark, [("/r0/f1", 2)])
    for df in (diff.detect_changes(other, base), diff.stale(base, other), diff.purge(base, other), diff.upsert_manifest(base, other), diff.delete_from_manifest(base, other)):
        plan = plan_of(df)
        scan = next(k for k, line in enumerate(plan.splitlines()) if "FileScan parquet" in line and "Bucketed: true" in line)
        depth = len(plan.splitlines()[scan]) - len(plan.splitlines()[scan].lstrip(" :+-|*()0123456789"))
        for line in reversed(plan.splitlines()[:scan]):
            at = len(line) - len(line.lstrip(" :+-|*()0123456789"))
            if at < depth:
                depth = at
                assert "Exchange" not in line, plan


def test_selected_roots_prune_partitions(spark):
    root = scratch(spark, "m")
    snapshots.commit(spark, root, manifest(spark, [(f"/r{k}/f{n}", 1) for k in range(4) for n in range(3)] + [("/top", 1)]))
    local, remote = snapshots.read_manifest(spark, root), manifest(spark, [("/r1/f0", 1), ("/r2/x", 1)])
    names = spark.createDataFrame([("r1",), ("r2",)], "root string")
    want = {("/r1/f0", "same"), ("/r2/x", "new"), ("/top", "delete"), *((f"/r{k}/f{n}", "delete") for k, n in ((1, 1), (1, 2), (2, 0), (2, 1), (2, 2)))}
    for roots in (["/r1/x", "r2"], names):
        plan = jobs.download_plan(remote, local, roots=roots, snapshot=True)
        assert set(map(tuple, plan.collect())) == want
        filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(plan))
        assert any("root" in f and (" IN " in f or "dynamicpruning" in f) for f in filters), plan_of(plan)


def test_two_writers_both_survive(spark):
    root = scratch(spark, "m")
    snapshots.commit(spark, root, manifest(spark, [("/a/0", 1), ("/b/0", 1)]))
    failed = []

    def write(rows):
        try:
            snapshots.commit(spark, root, manifest(spark, rows))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    writers = [threading.Thread(target=write, args=([(f"/{r}/{k}", 1)],)) for k, r in enumerate("aabb", 1)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and snapshots.versions(spark, root) == [0, 1, 2, 3, 4]
    assert rows_of(spark, root) == [("/a/0", 1), ("/a/1", 1), ("/a/2", 1), ("/b/0", 1), ("/b/3", 1), ("/b/4", 1)]


def test_only_one_claims_a_version_and_a_touched_root_is_done_anew(spark, monkeypatch):
    root = scratch(spark, "m")
    log = snapshots.Log(spark, root)
    entry = {"buckets": 2, "roots": {}, "batches": {}}
    assert log.claim(0, entry) and not log.claim(0, entry | {"buckets": 9}) and log.entry(0)["buckets"] == 2
    puts, put = [], snapshots.Log.put

    def between(self, rows, buckets):
        out = put(self, rows, buckets)
        puts.append(out)
        if len(puts) == 1:  # another writer comes first, to the same root
            snapshots.commit(spark, root, manifest(spark, [("/a/other", 1)]))
        elif len(puts) == 4:  # and here to another root
            snapshots.commit(spark, root, manifest(spark, [("/b/other", 1)]))
        return out

    monkeypatch.setattr(snapshots.Log, "put", between)
    snapshots.commit(spark, root, manifest(spark, [("/a/mine", 1)]))
    assert len(puts) == 3 and rows_of(spark, root) == [("/a/mine", 1), ("/a/other", 1)]
    snapshots.commit(spark, root, manifest(spark, [("/a/more", 1)]))
    assert len(puts) == 5 and len(rows_of(spark, root)) == 4


def test_a_batch_is_done_once(spark):
    root = scratch(spark, "m")
    assert snapshots.commit(spark, root, manifest(spark, [("/a/1", 1)]), batch=("s", 0)) == 0
    assert snapshots.commit(spark, root, manifest(spark, [("/a/1", 9)]), batch=("s", 0)) == 0
    assert snapshots.commit(spark, root, manifest(spark, [("/a/1", 2)]), batch=("t", 0)) == 1
    assert rows_of(spark, root) == [("/a/1", 2)]


def test_a_path_that_arrives_twice_is_new_once(spark):
    root, out, notes, files = (scratch(spark, x) for x in ("m", "o", "n", "f"))
    for rows in ([("/a/1", 1), ("/a/1", 2)], [("/a/1", 2), ("/b/1", 1)]):
        manifest(spark, rows).coalesce(1).write.mode("append").parquet(files)
        streams.stream_reconcile(spark.readStream.schema(MANIFEST).parquet(files), root, out, notes).awaitTermination()
    found = spark.read.schema("path string, action string, batch int").parquet(out)
    assert sorted(map(tuple, found.collect())) == [("/a/1", "new", 0), ("/a/1", "same", 1), ("/b/1", "new", 1)]
    assert rows_of(spark, root) == [("/a/1", 2), ("/b/1", 1)]


def test_nothing_below_a_failed_listing_is_deleted(spark):
    remote = manifest(spark, [("/r/a.txt", 1)])
    local = manifest(spark, [("/r/a.txt", 1), ("/r/f/b.txt", 1), ("/r/f/g/c.txt", 1), ("/r/fx.txt", 1), ("/r/old.txt", 1)])
    failed = spark.createDataFrame([("/r/f",)], "path string")
    with pytest.raises(RuntimeError):
        jobs.download_plan(remote, local, failed_listings=failed)
    plan = jobs.download_plan(remote, local, failed_listings=failed, on_listing_error="skip")
    assert sorted(map(tuple, plan.collect())) == [("/r/a.txt", "same"), ("/r/fx.txt", "delete"), ("/r/old.txt", "delete")]
    content = spark.createDataFrame([], "path string, content string")
    dirs, entries = spark.createDataFrame([], "dir string, code int"), spark.createDataFrame([], "dir string, name string")
    for mode in (7, 1):
        with pytest.raises(RuntimeError):
            jobs.reconcile(remote, local, local, content, dirs, entries, jobs.Config(), mode, failed_listings=failed)
    out = jobs.reconcile(remote, local, local, content, dirs, entries, jobs.Config(on_listing_error="skip"), 7, failed_listings=failed, stored=local.where("path <> '/r/a.txt'"))
    assert ("/r/a.txt", "new") in set(map(tuple, out["download"].collect()))
    assert sorted(map(tuple, out["update"].collect())) == [("/r/fx.txt", "delete"), ("/r/old.txt", "delete")]
    assert sorted(r.path for r in out["manifest"].collect()) == ["/r/a.txt", "/r/f/b.txt", "/r/f/g/c.txt"]
    assert set(jobs.reconcile(remote, local, local, content, dirs, entries, jobs.Config(), 4)) == {"download"}
