"""Token counts row by row against the library, with texts that are spliced."""

import json
import os
import random

import pytest

from shelfmark.llm import queries, tokens

from .test_operators import ODD, docs_of

PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "​", "<|endoftext|>", "<|endof", "text|>", "a", "'s", "don't", "1", "é", "日本", "!", "?!", "　", "𝒳", "word", "\r\n"]


def library(texts):
    tool = tokens.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    return [len(e.ids) for e in tool.encode_batch_fast(texts, add_special_tokens=False)]


def test_spliced_counts_of_any_text_are_those_of_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) for _ in range(2000)] + ["x" * 5000, " " * 3000, "", "<|endoftext|>" * 400]
    texts += [" ".join("abc"[: rng.randint(1, 3)] * rng.randint(1, 9) for _ in range(900)), "word <|endoftext|>  two\n\n " * 200, "a" * 700 + " " * 900 + "b c " * 300]
    found = tokens.count_texts(tokens.tokenizer(queries.tokenizer_path("byte_bpe_50k.json")), texts, chunk=16, overlap=4)
    assert [n for n, _ in found] == library(texts)
    assert sum(c for _, c in found) > 10 * len(texts)


def test_chunks_that_do_not_align_are_done_anew():
    class Tool:
        """Tells other places for tokens than there are unless it sees the whole text."""

        def __init__(self, tool, size):
            self.tool, self.size = tool, size

        def encode(self, text, **options):
            return self.tool.encode(text, **options)

        def encode_batch(self, texts, **options):
            return [self.tool.encode(t if len(t) == self.size else "q" * len(t), **options) for t in texts]

    text = "some words in a row " * 50
    tool = tokens.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    assert tokens.count_texts(Tool(tool, len(text)), [text], chunk=64, overlap=8)[0][0] == library([text])[0]


def test_query_counts_as_the_library_does(spark, sf):
    rows = {r.doc_id: r for r in queries.op7_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for doc, n in zip(docs, library([d.text or "" for d in docs])):
        row = rows.pop(doc.doc_id)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((doc.text or "").encode()), n, n > 1024)
        assert (row.n_chunks > 1) == (len(tokens.splices(doc.text or "", tokens.CHUNK)) > 2)
    assert not rows


def test_odd_rows(spark):
    out = sorted(tokens.token_counts(docs_of(spark, ODD), queries.tokenizer_path("byte_bpe_50k.json"), chunk=64, overlap=8).collect(), key=repr)
    want = zip(ODD, library([t or "" for _, t in ODD]))
    assert sorted(((i, len((t or "").encode()), n) for (i, t), n in want), key=repr) == sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=repr)


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(queries.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [spec["added_tokens"][0] | {"rstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            tokens.check(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        tokens.check(queries.tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("given", [None, "true"])
def test_the_library_takes_no_threads_beside_the_tasks_unless_told(monkeypatch, given):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    if given:
        monkeypatch.setenv("TOKENIZERS_PARALLELISM", given)
    tokens.tokenizer.cache_clear()
    tokens.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == (given or "false")
