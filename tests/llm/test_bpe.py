"""Byte-level BPE through the registered query and on odd tables."""

import base64
import hashlib

from shelfmark.llm import bpe, queries

from .test_operators import DOC, ODD, docs_of


def library():
    import tiktoken

    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=queries.token_pattern(), mergeable_ranks=ranks, special_tokens={})


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_gives_the_library_s_ids_for_every_document(spark, sf):
    tool = library()
    rows = {r.doc_id: r for r in queries.op9_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = tool.encode_ordinary(doc.text or "")
        assert rows[doc.doc_id][1:] == (len(ids), digest(",".join(map(str, ids))), digest(doc.text or ""))


def test_odd_rows_and_empty_tables(spark):
    path, pattern, tool = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.token_pattern(), library()
    want = sorted(((i, tool.encode_ordinary(t or "")) for i, t in ODD), key=repr)
    docs = docs_of(spark, ODD)
    encoded = bpe.encode_ids(docs, path, pattern, keep=("source", "row"))
    assert encoded.columns == ["doc_id", "source", "row", "n_tokens", "ids"]
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == want
    found = bpe.encode_digests(docs, path, pattern).collect()
    assert sorted(((r.doc_id, r.ids_sha256) for r in found), key=repr) == sorted(((i, digest(",".join(map(str, ids)))) for i, ids in want), key=repr)
    none = spark.createDataFrame([], DOC)
    assert bpe.encode_digests(none, path, pattern).count() == bpe.encode_ids(none, path, pattern).count() == 0
    assert bpe.decode_ids(bpe.encode_ids(none, path, pattern), path).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [1]), (2, [])], "doc_id long, ids array<int>")
    assert sorted((len(r.data) > 0 for r in bpe.decode_ids(nulls, path).collect())) == [False, False, True]


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_BYTES", 5000)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 50)
    codec, tool = bpe.Codec(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.token_pattern()), library()
    texts = [" ".join(f"wörd{k * n}x" for k in range(60)) + "y" * 300 for n in range(1, 12)]
    for text in texts:
        assert codec.ids(text) == tool.encode_ordinary(text) and codec.text(text)[2].decode() == text
    assert len(codec.known) + len(codec.lists) < 40 and len(codec.encoder.fits) <= 50
    assert all(len(w) <= bpe.SHORT for w in (*codec.known, *codec.lists))


def test_words_met_often_are_worked_out_once(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_BYTES", 30_000)
    codec, tool, worked = bpe.Codec(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.token_pattern()), library(), []
    whole = codec.encoder.whole
    monkeypatch.setattr(codec.encoder, "whole", lambda data: worked.append(data) or whole(data))
    for n in range(10):
        text = "".join(f" often{'abcdefgh'[k]}" for k in range(8)) + "".join(f" rare{chr(97 + n)}{chr(97 + k)}y" for k in range(20))
        assert codec.ids(text) == tool.encode_ordinary(text) and codec.text(text)[2].decode() == text
    assert all(worked.count(f" often{c}".encode()) == 1 for c in "abcdefgh") and len(codec.known) + len(codec.lists) < 150


def test_a_worker_keeps_its_codec_between_tasks():
    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.token_pattern()
    assert bpe.codec(path, pattern) is bpe.codec(path, pattern)
