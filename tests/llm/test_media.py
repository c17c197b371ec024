"""Media columns: each column of the query against the bytes, and header-only reads."""

import hashlib
import tarfile
import zlib

import pytest

from shelfmark.llm import media, queries

from .test_operators import DOC, ODD, docs_of


def wanted(text):
    data = (text or "").encode()
    payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
    png = media.to_png(payload)
    rows = len(payload) // 192
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), f"png:192x{rows}:8:0:min={min(payload)}:max={max(payload)}:sum={sum(payload)}", 192, rows, 8)


def test_all_columns_of_every_document(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op4_media_columns(spark, sf).collect()
    assert len(found) == len(docs) and all(tuple(r)[1:] == wanted(docs[r.doc_id]) for r in found)


def test_odd_rows_and_empty_tables(spark):
    found = sorted((tuple(r) for r in media.media_columns(docs_of(spark, ODD)).collect()), key=repr)
    assert found == sorted(((i, *wanted(t)) for i, t in ODD), key=repr)
    assert media.media_columns(spark.createDataFrame([], DOC)).count() == 0


def test_headers_are_read_without_the_payloads(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/shards"
    places = media.index(media.store(docs_of(spark, ODD, 1), folder)).collect()
    assert len({p.digest for p in places}) == len(places) == len({media.payload_of(t)[1] for _, t in ODD})
    sizes = []

    class Reader(media.Reader):
        def read(self, shard, offset, length):
            sizes.append(length)
            return super().read(shard, offset, length)

    reader = Reader(folder)
    for p in places:
        width, height, depth, colour = media._header(reader, p.shard, p.offset, p.length)
        assert (width, depth, colour) == (192, 8, 0) and height >= 1
    assert set(sizes) == {media.HEADER}
    frame = spark.createDataFrame(places)
    assert {(r.digest, r.height) for r in media.headers(frame, folder).collect()} == {(r.digest, r.payload_bytes // 192) for r in media.read_back(frame, folder).collect()}


def test_shards_are_tar_files_that_name_their_payloads(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    catalog = media.store(docs_of(spark, ODD, 2), folder).collect()
    names = set()
    for shard in {r.shard for r in catalog}:
        with tarfile.open(f"{tmp_path}/shards/{shard}") as tar:
            for member in tar:
                payload = media.from_png(tar.extractfile(member).read())
                assert member.name == f"{hashlib.sha256(payload).hexdigest()}.png"
                names.add(member.name[:-4])
    assert names == {r.digest for r in catalog}
    with pytest.raises(ValueError):
        media.png_header(b"no image" * 5)
