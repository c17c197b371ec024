"""Stored files, listed and read by tasks."""

import pytest

from shelfmark.sources import tables

FILES = {
    "/top.strm": b"http://a/1\n", "/r0/t0/d 1.strm": "café\r\n".encode(), "/r0/t0/d%201+2#3?.strm": b"", "/r0/t0/d.nfo": b"x" * 70,
    "/_kept/.hidden.strm": b"h", "/r0/.sync/_x.strm": b"bad \xff byte", "/r1/.strm": b"only", "/r1/deep/er/still/ä.strm": b"d", "/r1/a.strm.bak": b"no",
}


@pytest.fixture
def base(tmp_path):
    for path, body in FILES.items():
        (tmp_path / path[1:]).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path[1:]).write_bytes(body)
    (tmp_path / "empty.strm").mkdir()
    return f"file://{tmp_path}"


def test_all_stored_files_are_listed_whatever_their_names(spark, base, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 2)
    for at in (base, base + "/"):
        assert sorted(map(tuple, tables.stored_files(spark, at).select("path", "length").collect())) == sorted((p, len(b)) for p, b in FILES.items())


def test_all_pointers_are_read_byte_for_byte(spark, base, monkeypatch):
    monkeypatch.setattr(tables, "BYTES", 3)
    found = tables.read_pointers(spark, base)
    assert found.dtypes == [("path", "string"), ("content", "string")]
    assert sorted((r.path, bytes(r.b)) for r in found.selectExpr("path", "CAST(content AS BINARY) AS b").collect()) == sorted((p, b) for p, b in FILES.items() if p.endswith(".strm"))


def test_the_driver_lists_no_stored_file(spark, base):
    for df in (tables.read_pointers(spark, base), tables.stored_files(spark, base)):
        assert not [f for f in df.inputFiles() if not f.endswith(".parquet")]


def test_an_empty_folder_has_no_files_and_a_missing_one_fails(spark, tmp_path):
    assert tables.stored_files(spark, f"file://{tmp_path}").count() == tables.read_pointers(spark, f"file://{tmp_path}").count() == 0
    with pytest.raises(Exception, match="[Nn]o such file|nowhere"):
        tables.stored_files(spark, f"file://{tmp_path}/nowhere").count()
