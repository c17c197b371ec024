"""Language identification: scripts, and Viterbi against all labellings of short texts."""

import itertools
import unicodedata

import numpy as np
import pyarrow as pa

from shelfmark.llm import language, queries, shared

from .test_operators import docs_of


def words(text):
    """(script, number of bytes) of each word of a text."""
    cell, first, script, _ = language.words_of(*shared.utf8(pa.array([text])))
    return [(language.SCRIPTS[s], int(n)) for s, n in zip(script, np.diff(np.append(first, len(cell))))]


def test_scripts_are_those_of_code_points():
    assert words("l’été “quoted” Việt don’t") == [("latin", n) for n in (1, 5, 6, 6, 3, 1)]
    assert words("ภาษาไทย हिन्दी தமிழ் 日本 かな 한국어 Ελλάς עברית العربية Հայ ქართ") == [("thai", 21), ("devanagari", 18), ("tamil", 15), ("han", 6), ("kana", 6), ("hangul", 9), ("greek", 10), ("hebrew", 10), ("arabic", 14), ("armenian", 6), ("georgian", 12)]
    assert words("12 … — € 😀 ☃ «»") == [] and words("𝒳a") == [("other", 5)] and words("жжa") == [("cyrillic", 5)]
    for text in ("é", "é", "ß1ß", "ª", "𠀀", "x​y"):
        assert sum(n for _, n in words(text)) == sum(len(c.encode()) for c in text if unicodedata.category(c)[0] in "LM")


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores, switch = rng.integers(-8, 0, (n, k)).astype(float), float(rng.integers(0, 8))
        worth = lambda path: sum(scores[i, x] for i, x in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(map(worth, itertools.product(range(k), repeat=n)))
        assert worth(language.viterbi(scores, switch).tolist()) == best
        kept = int(language.one_language(scores, np.array([0, n]), switch)[0])
        assert kept < 0 or worth([kept] * n) == best


def test_model_is_the_sum_of_all_tasks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (language.learn(docs.repartition(n)) for n in (1, 200))
    assert one.langs == many.langs and np.array_equal(one.score, many.score) and np.array_equal(one.admits, many.admits)


def test_spans_of_mixed_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learn(docs)
    by = {r.lang: r.text for r in docs.where("length(text) BETWEEN 200 AND 2000 AND lang IN ('en', 'de')").dropDuplicates(["lang"]).collect()}
    mixed = by["en"] + " " + by["de"]
    row = language.identify(docs_of(spark, [(1, mixed), (1, mixed), (None, "§ 12")]), model).where("doc_id = 1").collect()
    assert row[0] == row[1] and [s.split(":")[0] for s in row[0].spans.split(",")][:1] == ["en"] and "de:" in row[0].spans and 0 < row[0].score < 1


def test_query_columns(spark, sf):
    import zlib

    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_language_id(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id] or ""))
