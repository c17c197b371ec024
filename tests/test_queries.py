"""Every catalog query against its SQL twin."""

import pytest
from pyspark.sql import functions as F

from shelfmark.fixtures import load
from shelfmark.operators import verify
from shelfmark.operators.diff import upsert_manifest
from shelfmark.plans import jobs as jobs_of_plans
from shelfmark.plans.queries import ORACLES, QUERIES
from shelfmark.streaming import jobs

from .compare import differ, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, sf, name):
    assert differ(QUERIES[name](spark, sf), duck(sf), ORACLES[name]) == ""


def test_stream_health_is_part_of_the_batch_result(spark, sf):
    streamed = QUERIES["stream_mirror_health"](spark, sf).selectExpr("unix_timestamp(start) AS start", "mirror", "n", "ok_count", "avg_ns")
    assert streamed.exceptAll(QUERIES["mirror_health_window"](spark, sf).select(*streamed.columns)).isEmpty()


def test_no_python_in_plans_and_no_nested_loop_in_change_detection(spark, sf):
    plan = QUERIES["change_detection"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan


def test_stream_health_is_the_batch_result_for_several_unordered_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in (2, 0, 3, 1):  # later days are in earlier files, too
        events.where(F.pmod(F.dayofyear("ts"), F.lit(4)) == k).repartition(2).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want = QUERIES["mirror_health_window"](spark, sf)
    have = QUERIES["stream_mirror_health"](spark, str(tmp_path)).withColumn("start", F.unix_timestamp("start")).select(want.columns)
    assert want.count() > 0 and sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect()))


def test_stream_upsert_replaces_local_rows_by_remote_ones(spark, sf, monkeypatch):
    replaced = []

    def upsert(base, changes):
        replaced.append(base.join(changes, "path", "left_semi").count())
        return upsert_manifest(base, changes)

    monkeypatch.setattr(jobs, "upsert_manifest", upsert)
    have, want = QUERIES["stream_upsert"](spark, sf), QUERIES["manifest_upsert"](spark, sf)
    assert sorted(map(tuple, have.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    both = load(spark, sf, "local_manifest").join(load(spark, sf, "remote_manifest"), "path", "left_semi").count()
    assert both > 0 and sum(replaced) == both


def test_walk_order_all_gives_each_file_of_each_root_a_position(spark, sf):
    paths = [r.path for r in load(spark, sf, "remote_manifest").collect()]
    assert len({p.split("/")[1] for p in paths}) > 1
    want = [(p, i) for i, p in enumerate(sorted(paths, key=lambda p: p.split("/")), 1)]
    assert sorted(map(tuple, QUERIES["walk_order_all"](spark, sf).collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("name", ["reconciled_update_after_failures", "reconciled_manifest_after_failures", "reconciled_pointers"])
def test_reconcile_leaves_few_joins_to_one_stage(spark, sf, monkeypatch, name):
    plans = []
    settle = jobs_of_plans.settle

    def noted(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, what)

    monkeypatch.setattr(jobs_of_plans, "settle", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.append(QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [p.count("SortMergeJoin") for p in plans if p.count("SortMergeJoin") > 9] == []  # each sorts both its sides


def test_rows_below_prefixes_are_those_that_are_not_exempt(spark):
    rows = spark.createDataFrame([(p,) for p in ("/a/b/c", "/a/b/c", "/a/bc", "/a/b", "/x/y", "/z", None)], "path string")
    prefixes = spark.createDataFrame([("/a/b/",), ("/a/",), ("/x/y/",), ("/a/",)], "prefix string")
    assert sorted(r.path for r in verify.below_prefix(rows, "path", prefixes).collect()) == ["/a/b", "/a/b/c", "/a/b/c", "/a/bc"]
    assert {r.path for r in verify.exempt_by_prefix(rows, "path", prefixes, "ancestors").collect()} == {"/x/y", "/z", None}
