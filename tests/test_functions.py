"""Scalar rules at their edges, and snapshots."""

from pyspark.sql import functions as F

from shelfmark.functions import http, paths, urls
from shelfmark.operators import diff
from shelfmark.sources.tables import read_manifest, versions, write_snapshot


def applied(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_paths(spark):
    assert applied(spark, paths.clean_path, ["/a/b/../c", "/a/./b/", "/../x", "//a//b", "/a/b/../../.."]) == ["/a/c", "/a/b", "/x", "/a/b", "/"]
    assert applied(spark, paths.ext, ["a.b.strm", "noext", "/d.x/noext", ".strm", "a."]) == [".strm", "", "", ".strm", "."]
    assert applied(spark, paths.root_of, ["/", "/a", "/a/b"]) == ["", "a", "a"]
    assert applied(spark, paths.normalise_prefix, [" a ", "/", "", "/x/"]) == ["/a/", None, None, "/x/"]


def test_walk_order(spark):
    names = ["/a.x", "/a/b/c", "/", "/a-b", "/a", "/a/b"]
    df = spark.createDataFrame([(n,) for n in names], "path string").orderBy(paths.walk_key(F.col("path")))
    assert [r[0] for r in df.collect()] == ["/", "/a", "/a/b", "/a/b/c", "/a-b", "/a.x"]


def test_headers(spark):
    assert applied(spark, http.content_length, ["12", " 12 ", "abc", ""]) == [12, 0, 0, 0]
    assert applied(spark, http.http_date_epoch, ["Wed, 21 Oct 2015 07:28:00 GMT", ""]) == [1445412480, -62135596800]


def test_urls(spark):
    assert applied(spark, urls.pointer_text, [" \t\u00a0x y\u0085\n", "a%20b"]) == ["x y", "a b"]
    assert applied(spark, urls.decode_uri_path, ["/a+b%E6%AF%8F?x=1", "/a%zz?y", "/p#q"]) == ["/a+b每", "/a%zz?y", "/p#q"]
    assert applied(spark, urls.encode_uri_path, ["/a b/(x)*~$&+,:;=@?#[]每.strm"]) == ["/a%20b/%28x%29%2A~$&+,:;=@%3F%23%5B%5D%E6%AF%8F.strm"]
    assert applied(spark, urls.strip_root, ["/d/x", "/data/x"]) == ["/x", "/ata/x"]


def test_snapshots_and_upsert(spark, tmp_path):
    row = lambda p, m: (p, p[1:], 1, m, "")
    schema = "path string, name string, size long, modified long, etag string"
    root = f"file://{tmp_path}/m"
    assert read_manifest(spark, root, missing_ok=True).isEmpty()
    base = spark.createDataFrame([row("/a", 1), row("/b", 1)], schema)
    changes = spark.createDataFrame([row("/b", 2), row("/b", 3), row("/c", 1)], schema)
    assert write_snapshot(base, root) == 0
    once = diff.upsert_manifest(read_manifest(spark, root), changes)
    assert write_snapshot(once, root) == 1 and versions(spark, root) == [0, 1]
    assert sorted((r.path, r.modified) for r in read_manifest(spark, root).collect()) == [("/a", 1), ("/b", 3), ("/c", 1)]
    assert diff.upsert_manifest(once, changes).exceptAll(once).isEmpty()
