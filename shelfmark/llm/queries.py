"""The registered queries of this folder, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, id_planes, language, licenses, media, mixing, ngrams, pii, prefix_trie, runs, tokens, urls, vectors
from .shared import settle


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngrams.ngram_components(_table(spark, sf_dir, "documents"), words=4, similar=85).select("doc_id", "n_shingles", "component_id")


def op2_embedding_near_dedup(spark, sf_dir):
    return vectors.vector_links(_table(spark, sf_dir, "embeddings"))


def op3_url_filters(spark, sf_dir):
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op4_media_columns(spark, sf_dir):
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return language.identify_held_out(_table(spark, sf_dir, "documents"))


def op6_license_scans(spark, sf_dir):
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_pii(spark, sf_dir):
    return pii.pii_spans(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), token_pattern())


def op10_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(settle(docs, "mix-sizes"), size=F.col("size"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op11_token_id_files(spark, sf_dir):
    return id_planes.token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_periodic_runs(spark, sf_dir):
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries():
    found = (op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_url_filters, op4_media_columns, op5_language_id, op6_license_scans, op7_token_counts, op8_pii, op9_byte_bpe, op10_mixing, op11_token_id_files, op12_periodic_runs, op13_prefix_trie)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op3_url_filters": urls.SQL, "op10_mixing": mixing.SQL}
