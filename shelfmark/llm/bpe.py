"""Operator 9: byte-level BPE. Longest matches from an automaton, backtracking on incompatible neighbours."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import pieces, small_batches

#: Bytes of words and their ids, in two turns, and number of token pairs, that a worker keeps; beyond these it forgets the
#: words of the turn before, and all pairs. An entry counts ENTRY bytes besides its texts; words of more than SHORT bytes
#: are never kept.
KEEP_BYTES, KEEP_PAIRS, ENTRY, SHORT = 192 << 20, 400_000, 160, 64
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    """Ranks of byte strings -> exact merges.

    A sequence of tokens is what the merges give iff each two neighbours are what the merges give for
    their joined bytes. So the longest token at each place is tried first, a shorter one if it does
    not go with its left neighbour, and a step back if none does; places found to lead nowhere are
    not tried again, which bounds the work by the length of the word.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.tree = ahocorasick.Automaton()
        #: Each path of the trie -> the longest token that it begins with, or -1.
        self.cut_back: dict[str, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            text = token.decode("latin-1")
            self.tree.add_word(text, rank)
            self.cut_back[text] = rank
        for token in [*self.cut_back]:
            best = -1
            for k in range(1, len(token)):
                best = self.cut_back.setdefault(token[:k], best)
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}

    def merges(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first: for the few bytes of two neighbours, and for tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none, get = 1 << 62, self.ranks.get
        joined = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined and (rank := min(joined)) < none:
            k = joined.index(rank)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joined[k]
            if k:
                joined[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(joined):
                joined[k] = get(parts[k] + parts[k + 1], none)
        return [self.ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= KEEP_PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self.merges(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self.shorter.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = self.shorter[token] = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
        return known

    def whole(self, data: bytes) -> list[int]:
        """Ids of the bytes of one match of the pattern."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        text, n = data.decode("latin-1"), len(data)
        dead = bytearray(n + 1)
        out: list[int] = []
        fits, bytes_of, longest_at = self.fits, self.bytes_of, self.longest_at
        at, token = 0, longest_at(text, 0)
        while at < n:
            end = at + len(bytes_of[token])
            if not dead[end]:
                fit = True
                if out and (fit := fits.get(out[-1] << 32 | token)) is None:
                    fit = self.fit(out[-1], token)
                if fit:
                    out.append(token)
                    at = end
                    token = longest_at(text, at) if at < n else -1
                    continue
            token = self.next_shorter(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(bytes_of[token])
                token = self.next_shorter(token)
        return out

    def longest_at(self, text: str, at: int) -> int:
        """The longest token that stands at a place: the trie's longest path, cut back to a token's end."""
        return self.cut_back[text[at : at + self.tree.longest_prefix(text[at : at + self.longest])]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class _Known(dict):
    """Words -> their ids as bytes; those of a word that is missing are worked out."""

    def __init__(self, work):
        self.work = work

    def __missing__(self, word: str) -> bytes:
        return self.work(word)


class Codec:
    """Texts -> ids and back, with the ids of short words kept between texts. Words met since the last turn are `known`,
    those of the turn before stand in `lists`: what is met often stays."""

    def __init__(self, path: str, pattern: str):
        self.encoder, self.words = encoder(path), regex.compile(pattern)
        self.decimal = {rank: str(rank) for rank in self.encoder.bytes_of}
        self.known: dict[str, bytes] = _Known(self.word)
        self.lists: dict[str, bytes] = {}
        self.kept = 0

    def word(self, word: str) -> bytes:
        """The ids of a word that is not known, which is remembered unless it is long."""
        ids = self.lists.get(word)
        if ids is None:
            ids = array("i", self.encoder.whole(word.encode())).tobytes()
        if len(word) > SHORT:
            return ids
        size = ENTRY + 4 * len(word) + len(ids)
        self.kept += size
        if self.kept > KEEP_BYTES // 2:
            self.lists = {**self.known}
            self.known.clear()
            self.kept = size
        self.known[word] = ids
        return ids

    def codes(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        return b"".join(map(self.known.__getitem__, self.words.findall(text)))

    def text(self, text: str) -> tuple[int, str, bytes]:
        """(number of ids, the ids in decimal, the bytes decoded from them)."""
        ids = array("i", self.codes(text))
        return len(ids), ",".join(map(self.decimal.__getitem__, ids)), self.encoder.decode(ids)

    def ids(self, text: str) -> list[int]:
        return array("i", self.codes(text)).tolist()


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in pieces(batches):
            rows = [tool.text(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": [n for n, _, _ in rows],
                "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in rows],
                "decoded_sha256": [hashlib.sha256(data).hexdigest() for _, _, data in rows],
            })

    return run


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text, any more) -> number of ids, digest of the ids, digest of the bytes decoded from them.

    Null texts are empty: no ids. Equal rows give equal rows, null doc_ids stay null, other columns are
    never read, an empty table gives an empty one. A plain map over the scan; the vocabulary is read by
    each worker from `path`, which must exist on every machine. What a worker keeps is bounded by
    KEEP_BYTES and KEEP_PAIRS, besides it holds a piece of texts, or the longest one, and its ids.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digests(path, pattern), SCHEMA)


def encode_ids(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs -> doc_id, the columns to keep, n_tokens and ids: the encoded documents themselves.

    Null texts have no ids; rows, null doc_ids and bounds are as in encode_digests. The columns to keep
    must not be called text, n_tokens or ids.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", *keep, "text")
    fields = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long", "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in pieces(batches):
            codes = [tool.codes(t or "") for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) // 4 for x in codes], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.frombuffer(b"".join(codes), np.int32)))
            yield pa.RecordBatch.from_pydict({**{f.name: batch.column(f.name) for f in fields}, "n_tokens": pa.array(sizes), "ids": ids})

    return rows.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary): the inverse of encode_ids, row by row; null ids give no bytes,
    other columns are never read, an empty table gives an empty one."""

    def run(batches):
        table = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "data": pa.array([table.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
