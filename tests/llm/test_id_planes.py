"""Files of id planes: exact round trips, and documents against the tokenizers library."""

import io
import random
import zlib

import numpy as np
import pytest

from shelfmark.llm import id_planes, queries, shared

from .test_operators import ODD, docs_of
from .test_tokens import PARTS, library


class File(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]

    def size(self):
        return len(self.getvalue())

    def close(self):
        pass


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("dtype", ["uint8", "uint32", "uint64"])
def test_planes_round_trip(kind, dtype):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (1, 50257, np.iinfo(dtype).max):
            values = rng.integers(0, min(top, np.iinfo(dtype).max), n, dtype=dtype, endpoint=True)
            planes = id_planes.to_planes(values, kind)
            assert len(planes) == values.dtype.itemsize * (8 if kind == "bit" else 1)
            assert (id_planes.from_planes(planes, n, dtype, kind) == values).all()
    assert id_planes.to_planes(np.full(64, 255, "uint32"))[1:] == [b""] * 3


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_gives_back_documents_and_any_stretch(kind):
    rng = random.Random(2)
    docs = [(None if k == 3 else -k, [rng.randrange(70000) for _ in range(rng.choice((1, 2, 7, 8, 9, 40)))]) for k in range(60)]
    file = File()
    writer = id_planes.Writer(file, kind, chunk=8)
    for k, (doc_id, ids) in enumerate(docs):
        writer.ids(np.array(ids[:1], np.uint32))
        writer.ids(np.array(ids[1:], np.uint32))
        writer.document(doc_id, len(ids))
        if k % 7 == 6 or k == len(docs) - 1:
            writer.end_block()
    writer.close()
    reader = id_planes.Reader(file)
    found = [row for b in range(len(reader.blocks)) for row in reader.block(b)]
    flat = [i for _, ids in docs for i in ids]
    first = 0
    for (doc_id, ids), row in zip(docs, found, strict=True):
        assert row == (doc_id, first, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        first += len(ids)
    for a, b in ((0, len(flat)), (5, 6), (8, 16), (7, 90), (3, 3)):
        assert [i for x in reader.stretches(a, b) for i in x.tolist()] == flat[a:b]
    with pytest.raises(ValueError):
        id_planes.Reader(File(file.getvalue()[:-1]))


def test_units_and_stretches_give_the_ids_of_the_library(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS + ["\x00", "<", "​ "]) for _ in range(rng.randint(0, 200))) for _ in range(1500)] + ["", " ", "a  b", "\x00 ", "<|endoftext|>", "x" * 4000, "<|endoftext|><|endof text|>"]
    path = queries.tokenizer_path("byte_bpe_50k.json")
    want = [e.ids for e in id_planes.encoder(path).tool.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(id_planes, "KNOWN_UNITS", 500)
    for stretch, together in ((16, 64), (1 << 20, 1 << 12)):
        found = [[] for _ in texts]
        for k, _, ids in id_planes.encode_texts(id_planes.Encoder(path), texts, stretch, together):
            found[k] += ids.tolist()
        assert found == want


def brute(rows):
    tool = id_planes.encoder(queries.tokenizer_path("byte_bpe_50k.json")).tool
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op11_token_id_files(spark, sf).collect())) == brute(docs)


def test_odd_rows_in_many_blocks_and_files(spark, monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    found = sorted(map(tuple, id_planes.token_files(docs_of(spark, ODD), path, planes="bit", file_ids=1).collect()), key=lambda r: r[1])
    want = brute(sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert found == want
    assert id_planes.token_files(docs_of(spark, []), path).collect() == []


def test_one_doc_id_with_all_rows_is_spread_and_keeps_its_places(spark):
    rows = [(7, "a b c"), (7, "d")] * 300
    path, folder = queries.tokenizer_path("byte_bpe_50k.json"), shared.scratch(spark, "t")
    blocks = shared.settle(id_planes.write_ids(docs_of(spark, rows, 5), path, folder), "t-blocks")
    assert blocks.select("part").distinct().count() == shared.spread(spark)
    found = sorted(map(tuple, id_planes.token_files(docs_of(spark, rows, 5), path).collect()), key=lambda r: r[1])
    assert {r[2:] for r in found} == {r[2:] for r in brute(rows[:2])} and len(found) == 600
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:])) and found[0][1] == 0
    lengths = [r[2] for r in found]
    assert lengths in (sorted(lengths), sorted(lengths, reverse=True))


def test_folders_that_no_library_reaches_are_refused():
    with pytest.raises(Exception, match="(?i)filesystem|scheme|uri"):
        shared.file_system("nostore://a/b")


def test_units_met_often_go_through_the_library_once(monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(id_planes, "KNOWN_UNITS", 60)
    encoder, seen = id_planes.Encoder(path), []
    library = encoder.tool

    class Counted:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **more)

    encoder.tool = Counted()
    often = [f" often{k}x" for k in range(9)]
    texts = ["".join(["begin", *often, *(f" rare{n}y{k}," for k in range(40)), *often]) for n in range(8)]
    for text in texts:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(sum(x.count(unit) for x in seen) == 1 for unit in often)
    assert sum(map(len, seen)) < 1.1 * len("".join({u for text in texts for u in text.split(" ")}) + " " * 9 + " " * 320)
    assert len(encoder.known) + len(encoder.older) < 4 * 60
