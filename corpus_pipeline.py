"""A training corpus from raw documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, language, mixing, ngrams, pii
from shelfmark.llm.queries import token_pattern, tokenizer_path
from shelfmark.llm.shared import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go; the model is learned from those with a language given.

    Null texts and texts without letters go, a null lang is filled, equal rows fare alike, null doc_ids
    stay null, further columns may have any name, an empty table gives an empty one.
    """
    return language.keep_identified(docs, language.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity stays: that of the smallest doc_id, once.

    Texts without words all stay, rows without doc_id as far as no row with one is in their group; further
    columns may have any name, an empty table gives an empty one.
    """
    return ngrams.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to the names of their kinds.

    Null and empty texts stay as they are, no row goes, equal rows stay equal, further columns may have any
    name, an empty table gives an empty one.
    """
    return pii.redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words weigh nothing, null sources are one source, rows that agree in doc_id, source and
    size are interchangeable, further columns may have any name, an empty table gives an empty one.
    """
    return mixing.emit_mix(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids: doc_id, source and lang as far as docs has them, n_tokens, ids; all other columns go, whatever
    their names.

    Null and empty texts have no ids, very long ones are encoded whole, null doc_ids stay null, repeated rows are
    encoded each, an empty table gives an empty one.
    """
    keep = tuple(c for c in ("source", "lang") if c in docs.columns)
    return bpe.encode_ids(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), token_pattern(), keep=keep)


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mixing", mix_to_weights),
    ("byte-level BPE", encode_text),
]

#: SQL cannot express the stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage{i}")
    return docs
