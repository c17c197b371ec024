"""Operator 7: token counts. Documents are encoded in overlapping chunks and spliced where both sides agree."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pieces, small_batches

#: Least characters of a chunk, and of the text that it shares with its neighbours beyond either splice.
CHUNK, OVERLAP = 4096, 128
#: Chunks that are encoded together.
TOGETHER = 256
LIMIT = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long"
#: Where a text may be spliced: a blank, tab or line end after what is no white space by any definition.
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85\u200b\ufeff])[ \t\n\r]")


def check(path: str) -> None:
    """Refuse tokenizers for which _STABLE is not proven.

    The byte-level pattern has no match that goes on from other characters into white space, and looks
    ahead only from white space: what stands before a stable place is cut up alike whatever follows,
    and at the place itself a match begins. That needs the pattern itself, no normaliser and no added
    prefix, and special strings without white space that take none from their sides. Tokens never span matches.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    bare = not spec.get("normalizer") and (spec.get("post_processor") or {}).get("type") in (None, "ByteLevel")
    special = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ()))
    if not (plain and bare and special):
        raise ValueError(f"no stable splices are known for the tokenizer in {path}")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer, without threads of its own unless the environment asks for them: each core has its task
    already, and such threads spend their CPU seconds on waiting for work and for each other."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    check(path)
    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def splices(text: str, chunk: int) -> list[int]:
    """0, then the first stable place at least `chunk` characters on, and so on; the text's length is the last.

    Where a text has no stable place for long, a chunk is as much longer; each character is looked at once.
    """
    out = [0]
    while found := _STABLE.search(text, out[-1] + chunk):
        out.append(found.start())
    return [*out, len(text)]


def chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(begin, first, last, end): a chunk counts from one splice to the next and is encoded with the overlap on both sides."""
    at = splices(text, chunk)
    for first, last in zip(at, at[1:]):
        yield max(0, first - overlap), first, last, min(len(text), last + overlap)


class Splicer:
    """Counts a text's tokens from its chunks' encodings, which come in order."""

    def __init__(self, text: str) -> None:
        self.text, self.total, self.chunks, self.tail, self.aligned = text, 0, 0, None, True

    def add(self, encoding, begin: int, first: int, last: int, end: int) -> None:
        """Count the chunk's own tokens. At its first splice a token must begin in both encodings, and the
        tokens after it, as far as the last stable place of the shared text, must be the same."""
        ids = encoding.ids
        mine = 0 if first == begin else self._place(encoding, first - begin)
        if self.tail is not None:
            self.aligned &= mine is not None and self.tail[0] is not None and ids[mine : mine + len(self.tail[1])] == self.tail[1]
        upto = len(ids) if last == end else self._place(encoding, last - begin)
        self.total += (upto or 0) - (mine or 0)
        self.chunks += 1
        if last == end:
            self.tail = None
            return
        sure = max((m.start() for m in _STABLE.finditer(self.text[begin:end], last - begin)), default=last - begin)
        stop = self._place(encoding, sure)
        self.tail = upto, ids[upto:stop] if upto is not None and stop is not None else []

    @staticmethod
    def _place(encoding, char: int) -> int | None:
        """Number of tokens before a character, if one begins there."""
        token = encoding.char_to_token(char)
        return token if token is not None and encoding.token_to_chars(token)[0] == char else None


def count_texts(tool, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(tokens, chunks) of each text. TOGETHER chunks at most are encoded at a time, whatever the texts' lengths.

    A text whose neighbours don't align is done anew with four times the overlap, at worst each chunk
    with the whole text, which needs no splice to be right.
    """
    found = [Splicer(t) for t in texts]
    plan = ((k, *c) for k, t in enumerate(texts) for c in chunks(t, chunk, overlap))
    while group := [*islice(plan, TOGETHER)]:
        encoded = tool.encode_batch([texts[k][begin:end] for k, begin, _, _, end in group], add_special_tokens=False)
        for (k, begin, first, last, end), encoding in zip(group, encoded):
            found[k].add(encoding, begin, first, last, end)
    out = []
    for text, splicer in zip(texts, found):
        if splicer.aligned:
            out.append((splicer.total, splicer.chunks))
        elif overlap >= len(text):
            out.append((len(tool.encode(text, add_special_tokens=False).ids), 1))
        else:
            out += count_texts(tool, [text], chunk, 4 * overlap)
    return out


def _counts(path: str, limit: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = count_texts(tool, texts, chunk, overlap)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array([n for n, _ in found], pa.int64()), "over_limit": pa.array([n > limit for n, _ in found], pa.bool_()), "n_chunks": pa.array([c for _, c in found], pa.int64())})

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, text, any more) -> bytes and tokens of each text, as the library would count them, and its chunks.

    All texts go one way: chunks of `chunk` characters or more, overlapping on both sides, are encoded
    apart and spliced at stable places (see check) at which the encodings are seen to agree; n_chunks
    says how many. Null texts are empty: 0 tokens, one chunk. Equal rows give equal rows, null doc_ids
    stay null, columns of any other name are never read, an empty table gives an empty one. A plain map
    over the scan; memory is bounded by a piece of texts, or the longest text, and TOGETHER encodings.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_counts(path, limit, chunk, overlap), SCHEMA)
