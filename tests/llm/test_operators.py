"""The training-data operators on small tables: brute force, round trips, and odd rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe, language, licenses, media, mixing, ngrams, pii, queries, shared, tokens, urls, vectors

from ..compare import differ, duck

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "One"), (4, "One"), (None, "a b c d e"), (5, "x " * 30000), (6, "Ünï ço 日本 <|endoftext|> a"), (7, "12 345 +49 170 1234567 a@b.co 4111 1111 1111 1111 10.0.0.255")]


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOC).repartition(parts)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf, name):
    assert differ(queries.queries()[name](spark, sf), duck(sf), queries.oracle_sql()[name]) == ""


def brute_components(rows, n=5, similar=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 60), 1 << 60 if i is None else i)
    return Counter((i, len(sets[k]), least[find(k)] if least[find(k)] < 1 << 60 else None) for k, (i, _) in enumerate(rows))


def test_ngrams_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    for i in range(60, 150):  # a group of near copies, many at the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(base)) for i in range(150, 170)] + [(200, None), (201, ""), (202, "A b"), (203, "a B"), (203, "a B")]
    for n, similar in ((5, 80), (4, 85)):
        found = ngrams.ngram_components(docs_of(spark, rows), n, similar).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, found)) == brute_components(rows, n, similar)
    kept = {r.doc_id for r in ngrams.keep_one(docs_of(spark, rows)).collect()}
    assert kept == {i for i, _, c in brute_components(rows) if i == c}


def test_components_grow_with_more_edges(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    root = shared.components(edges([(1, 2), (3, 4), (5, 6)]), "t")
    for more, want in (([], {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}), ([(2, 4), (1, 3), (7, 8), (6, 9)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5, 7: 7, 8: 7})):
        assert sorted(map(tuple, shared.joined_components(root, edges(more), "t").collect())) == sorted(want.items())


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 16)).astype(np.float32)
    x = np.vstack([x, x[:60] + 0.08 * rng.standard_normal((60, 16)).astype(np.float32), x[:5], x[:1] * 2])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [])]
    out = {r.vec_id: r for r in vectors.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9).sum(1) - 1
    have = np.array([out[i].n_links for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in (900, 901, 902, 903))


def test_bpe_equals_the_library(spark):
    import tiktoken

    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=queries.token_pattern(), mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(path, queries.token_pattern())
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh etaoin ñéß日\n0123.,") for _ in range(400)) for _ in range(60)] + ["a" * 3000, "", "ab" * 700 + "日本語" * 90]
    for text in texts:
        n, ids, data = codec.text(text)
        assert [int(i) for i in ids.split(",") if i] == library.encode_ordinary(text) == codec.ids(text) and data.decode() == text
    rows = docs_of(spark, ODD)
    ids = bpe.encode_ids(rows.where("doc_id <= 7"), path, queries.token_pattern())
    assert sorted((r.doc_id, bytes(r.data).decode()) for r in bpe.decode_ids(ids, path).collect()) == sorted((i, t or "") for i, t in ODD if i)


def test_personal_data():
    text = "mail a.b@c.de or 10.1.2.3, 999.1.1.1, card 4111 1111 1111 1111, +49 (170) 1234567, DE89 3704 0044 0532 0130 00; 4111 1111 1111 1112"
    base, spans = pii.find(text)
    assert [(k, text[a:b]) for a, k, b in base] == [("email", "a.b@c.de"), ("ip", "10.1.2.3"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (170) 1234567")]
    assert "iban" in {s[1] for s in spans}
    assert "4111 1111 1111 1111" not in pii.redact_text(text) and pii.redact_text("plain 12 words") == "plain 12 words"


@pytest.mark.parametrize("after", [" BIC COBADEFF", " EUR 500", " 2024-01-05", " TRANSFER", " NO9386011117947", " GB82 WEST 1234 5698 7654 32", "; OK", ""])
def test_account_numbers_with_capitals_and_digits_around_them(after):
    for number in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"):
        for before in ("", "AB12 ", "REF AB12 3456 7890 "):
            text = before + number + after
            found = [text[a:b] for a, kind, b, _ in pii.find(text)[1] if kind == "iban"]
            assert found == [number, *([after[1:]] if after[1:3] in ("NO", "GB") else [])]
            assert number not in pii.redact_text(text) and "<IBAN>" in pii.redact_text(text)


def test_media_round_trip(spark, odd):
    rows = {(r.doc_id, r.n_bytes): r for r in media.media_columns(odd).collect()}
    for i, t in ODD:
        n, payload = media.payload_of(t)
        row = rows[i, n]
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.payload_bytes == len(payload) and len(payload) % 192 == 0
        assert media.from_png(media.to_png(payload)) == payload


def test_language_spans_and_held_out_accuracy(spark, sf):
    found = queries.op5_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    total, right = found.count(), found.where("lang = lang_pred").count()
    assert right >= 0.95 * total
    scores = np.array([[0.0, -3.0]] * 6 + [[-3.0, 0.0]] * 6)
    assert language.viterbi(scores, 4.0).tolist() == [0] * 6 + [1] * 6
    assert language.one_language(scores, np.array([0, 12]), 4.0).tolist() == [-1]
    assert language.one_language(scores, np.array([0, 12]), 40.0).tolist() == [0]


def test_licences(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0 xx"), (2, "CC BY and cc by; the MIT License"), (3, "nothing here"), (4, None)]
    out = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, rows)).collect()}
    assert out[1].base_labels == "apache" and out[1].first_word == 3 and out[1].n_words == 9 and "apache" in out[1].labels
    assert out[2].n_base == 3 and out[2].base_labels == "cc-by,mit" and (out[2].first_word, out[2].last_word) == (0, 6)
    assert out[3].labels == "" and out[4].n_words == 0 and out[4].first_word is None


def test_licences_go_on_over_foreign_words(spark):
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without tiny modification, are permitted provided that the following conditions are met"
    far = bsd.replace("tiny", "tiny wee little mini")
    out = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, [(1, lgpl), (2, bsd), (3, far), (4, "are permitted provided that the"), (5, "following conditions are met and")])).collect()}
    assert out[1].labels == "lgpl" and out[1].spans == "lgpl:0:44"
    assert out[2].labels == "bsd" and out[2].spans == "bsd:0:22" and out[2].score == 1.0
    assert out[3].spans == "bsd:0:11,bsd:15:25"
    assert out[4].spans == "bsd:0:5"


@pytest.mark.parametrize("size", [1, 20])
def test_urls_without_labels_stand_apart_from_rare_labelled_sections(spark, size):
    paths = [f"/de/p{i}" for i in range(3 * size)] + [f"/s{k}/p{i}" for k in range(10) for i in range(3 * size)] + [f"/en/p{i}" for i in range(67 * size)]
    rows = [(i, f"http://example.com{p}") for i, p in enumerate(paths)]
    out = {r.path: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {p: r.verdict for p, r in out.items()} == {p: "block" if p.startswith("/de/") else "allow" for p in paths}


def test_few_labels_reject_no_template(spark):
    paths = [f"/pa{i}" for i in range(60)] + [f"/q{i}" for i in range(900)]  # one url a segment: all are variable
    out = urls.judge_urls(spark.createDataFrame([(i, f"http://e.com{p}") for i, p in enumerate(paths)], "page_id long, url string"), (("block", "e.com/pa"),))
    assert {r.path: r.verdict for r in out.collect()} == {p: "block" if p.startswith("/pa") else "allow" for p in paths}


def test_documents_in_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learn(docs)
    odd = [(1, "1234 a 5678 ### $$ 99"), (2, "q"), (3, "x7f9 zz kq 0x"), (4, "Привет мир как дела"), (5, "你好 世界"), (6, "Zażółć gęślą jaźń, proszę przeczytać ten krótki tekst"), (7, None), (8, "12 !"), (9, "the and of that"), (10, "αβγδ the")]
    odd = docs_of(spark, odd).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.doc_id, r.lang) for r in language.keep_identified(odd, model).collect()} == {(9, "en")}
    assert language.keep_identified(docs, model).exceptAll(docs).isEmpty() and docs.exceptAll(language.keep_identified(docs, model)).isEmpty()


def test_mix_comes_near_its_targets(spark, sf):
    out = queries.op10_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= max(0.1 * r["max(target)"], 3 * r["max(size)"])
    assert out.where("taken > 3 * size").isEmpty()


def test_odd_rows_and_empty_tables(spark, odd, none):
    model = language.learn(odd)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    for run in (ngrams.ngram_components, pii.pii_spans, media.media_columns, licenses.license_scan, language.identify_held_out, mixing.mix_sources, lambda d: tokens.token_counts(d, path), lambda d: language.identify(d, model)):
        assert run(odd).count() == len(ODD)
        assert run(none).count() == 0
    for run in (pii.redact, ngrams.keep_one, mixing.emit_mix, lambda d: language.keep_identified(d, model)):
        assert run(odd).columns == odd.columns and run(none).count() == 0
    pages = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (3, "http://A.net", "h"), (4, "x://e.net/?q", "h"), (4, "x://e.net/?q", "h")], "page_id long, url string, host string")
    out = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect())
    assert out[2] == (3, "a.net", "", None, "allow") and out[3] == out[4] == (4, "e.net", "/", "net/", "block")
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert vectors.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
