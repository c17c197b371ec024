"""The pipeline against the same steps in plain Python."""

from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import bpe, mixing, pii, queries

from .test_operators import brute_components


def test_pipeline(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    spoken = [(i, d.text) for i, d in docs.items() if d.text and any(c.isalpha() for c in d.text)]
    kept = {i for i, _, c in brute_components(spoken) if i == c}
    assert {r.doc_id for r in out} <= kept and len({r.source for r in out}) == len({docs[i].source for i in kept})
    codec = bpe.Codec(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.token_pattern())
    for r in out:
        assert r.ids == codec.ids(pii.redact_text(docs[r.doc_id].text)) and r.n_tokens == len(r.ids)


def test_pipeline_rows_are_those_of_the_mix_without_unknown_languages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(1 << 40, "Привет мир как дела", None), ((1 << 40) + 1, "1234 a 5678 ### $$ 99", None), ((1 << 40) + 2, "你好 世界", None), ((1 << 40) + 3, "the and of that", None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("source", F.lit(docs.first().source))
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() if r.doc_id < 1 << 40 or r.doc_id == (1 << 40) + 3]
    kept = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in rows]) if i == c}
    kept = [{"doc_id": r.doc_id, "source": r.source, "text": pii.redact_text(r.text)} for r in rows if r.doc_id in kept]
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(kept))
    want = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall() if taken}
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
