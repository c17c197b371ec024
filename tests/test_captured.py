"""Links by tokens, and listings of several pages."""

import json

from pyspark.sql import functions as F

from shelfmark.functions.html import anchors, attribute, references
from shelfmark.sources import captured

LINKS = [
    ('<a data-href="wrong" href="right.txt">x</a>', ["right.txt"]),
    ('<a title="a > b" href="lost.txt">', ["lost.txt"]),
    ("<a href='&#99;ode.txt'>", ["code.txt"]),
    ('<a href="caf&eacute;.txt"><a href="&notin;&notit;&amp">', ["café.txt", "∉&notit;&"]),
    ('<a href="?a=1&copy=2&copy;&lt&#x1F600;&#x80;&#0;&#xD800;&#99999999999;&bogus;&">', ["?a=1&copy=2©<😀€���&bogus;&"]),
    ("<A\nHREF = bare.txt class=x>", ["bare.txt"]),
    ('<a class=it\'s href="b">', ["b"]),
    ('<a href="x"class="y"/><a/href=z>', ["x", "z"]),
    ('<a href=>1</a><a href>2</a><a name="n">', ["", "", None]),
    ('<!-- <a href="no"> --><script>"<a href=no>"</script ><style><a href=no></style><textarea><a href=no></textarea><a href=yes>', ["yes"]),
    ("<!--><a href=yes><!doctype a href=no><?a href=no?></a href=no></ a href=no>", ["yes"]),
    ("<abbr href=no><area href=no><address href=no><b a href=no>", []),
    ('<a href=one>< a href=no><a href="two', ["one"]),
    ('<p title="<a href=no>"><a href=in>1<a href="first" href="second">', ["in", "first"]),
    ("<script><a href=no>", []),
    ("a < b & c > d <a href='it\"s'>", ['it"s']),
    ("<title>&lt;<a href=no></title><plaintext><a href=no>", []),
    ("", []),
]


def test_anchors_and_their_links(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(LINKS)], "k int, html string")
    found = df.select("k", F.transform(anchors(F.col("html")), lambda t: attribute(t, "href")).alias("href")).collect()
    for k, href in found:
        assert href == LINKS[k][1], LINKS[k][0]


def test_long_pages_overflow_nothing(spark):
    many = "<a " + "b='c' " * 30000 + "href=x>" + "<p>" * 30000 + "<!-- " + "-" * 100_000 + "--><a href=y>"
    df = spark.createDataFrame([(many,), (None,)], "html string")
    assert [r[0] for r in df.select(F.transform(anchors(F.col("html")), lambda t: attribute(t, "href"))).collect()] == [["x", "y"], None]


def test_references_without_a_reference(spark):
    df = spark.createDataFrame([("plain",), (None,), ("",), ("&",), ("a&b&&amp;amp;",)], "t string")
    assert [r[0] for r in df.select(references(F.col("t"))).collect()] == ["plain", None, "", "&", "a&b&&amp;"]


def body(names, total, code=200):
    return json.dumps({"code": code, "message": "m", "data": {"content": [{"name": n, "size": 1, "is_dir": False, "modified": "2024-01-02T00:00:00Z", "type": 2} for n in names], "provider": "x", "readme": "", "total": total, "write": False}})


def test_sets_of_pages(spark):
    pages = [
        ("/two", 1, body("ab", 3)), ("/two", 2, body("c", 3)),
        ("/repeated", 1, body("ab", 4)), ("/repeated", 1, body("ab", 4)),
        ("/gap", 1, body("ab", 4)), ("/gap", 3, body("cd", 4)),
        ("/late", 2, body("cd", 4)),
        ("/short", 1, body("ab", 4)), ("/short", 2, body("bc", 4)),
        ("/empty", 1, body("", 0)),
        ("/gone", 1, '{"code":500,"message":"x","data":null}'),
        ("/half", 1, body("a", 2)), ("/half", 2, '{"code":500,"message":"x","data":null}'),
    ]
    df = spark.createDataFrame(pages, "dir string, page int, body string")
    assert dict(map(tuple, captured.listing_complete(df).collect())) == {"/two": True, "/repeated": False, "/gap": False, "/late": False, "/short": False, "/empty": True, "/gone": None, "/half": None}
    assert dict(map(tuple, captured.listing_status(df).collect())) == {"/two": 200, "/repeated": 206, "/gap": 206, "/late": 206, "/short": 206, "/empty": 200, "/gone": 404, "/half": 404}
    assert sorted(r.name for r in captured.catalog_entries(df).where("dir = '/repeated'").collect()) == ["a", "b"]


def test_the_latest_capture_of_a_page_counts(spark):
    rows = [("/d", 1, 5, body("z", 1)), ("/d", 1, 9, body("a", 1)), ("/d", 1, 7, '{"code":500,"message":"x","data":null}')]
    df = spark.createDataFrame(rows, "dir string, page int, captured int, body string")
    assert [r.name for r in captured.catalog_entries(df).collect()] == ["a"] and captured.listing_status(df).first().code == 200
