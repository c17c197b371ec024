"""Operator 11: token-ID output. Fixed-size blocks of ids transposed to byte or bit planes, each compressed, with a chunk index."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import file_system, pieces, scratch, settle, small_batches, spread

MAGIC = b"IDPLANE1"
#: Ids of a chunk; a document block ends at so many ids or documents; a file ends at the block that fills it.
CHUNK, BLOCK_IDS, BLOCK_DOCS, FILE_IDS = 1 << 16, 1 << 22, 1 << 14, 1 << 28
#: "byte": a plane for each byte of an id, "bit": one for each bit.
PLANES, LEVEL = "byte", 3
#: The id that ends each document.
END_ID = 0
#: Characters of a text that are cut into units at a time, and bytes of text that are encoded together.
STRETCH, TOGETHER = 1 << 20, 4 << 20
#: Units from which a worker's known ones become the older ones, of which it forgets those before; the longest that it
#: remembers; and new units that go through the library as one text.
KNOWN_UNITS, KNOWN_CHARS, JOINED = 600_000, 64, 1 << 11
BLOCKS = "part int, seq long, file string, block long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Where units begin (see tokens.check), and white space with a blank behind it; a text without one is cut at each blank.
_PLACES = re.compile(tokens._STABLE.pattern.replace("[ ", "(?=[ ") + ")")
_UNSTABLE = re.compile(r"[\s\x1c-\x1f\x85\u200b\ufeff] ")
#: Units that begin and end so that between any two of them is a stable place.
_JOINABLE = re.compile(r"[ \t\n\r](?s:.*)(?<=[^\s\x1c-\x1f\x85\u200b\ufeff])")


# --- the file format -------------------------------------------------------------------------------------------


def to_planes(values: np.ndarray, kind: str = PLANES) -> list[bytes]:
    """The planes of an array of unsigned integers, lowest first, each compressed; a plane of zeros is empty."""
    width = values.dtype.itemsize
    table = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<"), copy=False)).view(np.uint8).reshape(-1, width).T
    if kind == "bit":
        table = np.concatenate([np.packbits(row[None, :] >> np.arange(8, dtype=np.uint8)[:, None] & 1, axis=1) for row in table])
    tool = zstandard.ZstdCompressor(level=LEVEL)
    return [tool.compress(np.ascontiguousarray(row).tobytes()) if row.any() else b"" for row in table]


def from_planes(planes: list[bytes], n: int, dtype: str, kind: str = PLANES) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    size = n if kind == "byte" else -(-n // 8)
    tool = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(tool.decompress(p, max_output_size=size), np.uint8) if p else np.zeros(size, np.uint8) for p in planes]
    if kind == "bit":
        rows = [sum(np.unpackbits(rows[8 * k + bit], count=n) << np.uint8(bit) for bit in range(8)).astype(np.uint8) for k in range(width)]
    return np.stack(rows, axis=1).reshape(-1).view(np.dtype(dtype).newbyteorder("<")).astype(dtype, copy=False)


class Writer:
    """One file: chunks of ids, blocks of documents, then the index of both. Memory holds a chunk, a block's
    documents and the index."""

    def __init__(self, out, kind: str = PLANES, chunk: int = CHUNK):
        self.out, self.kind, self.chunk = out, kind, chunk
        self.at, self.n_ids, self.chunks, self.blocks = len(MAGIC), 0, [], []
        self.held, self.n_held, self.docs, self.block_first = [], 0, [], 0
        out.write(MAGIC)

    def _put(self, values: np.ndarray) -> list[int]:
        """Where the planes stand and how long each is."""
        planes = to_planes(values, self.kind)
        self.out.write(b"".join(planes))
        place = [self.at, *map(len, planes)]
        self.at += sum(place[1:])
        return place

    def ids(self, ids: np.ndarray) -> None:
        """Append ids; whole chunks are written."""
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.chunk:
            all_ids = np.concatenate(self.held)
            whole = len(all_ids) - len(all_ids) % self.chunk
            for at in range(0, whole, self.chunk):
                self.chunks.append([self.chunk, *self._put(all_ids[at : at + self.chunk])])
            self.held, self.n_held = [all_ids[whole:]], len(all_ids) - whole

    def document(self, doc_id: int | None, n: int) -> None:
        """The last n ids are a document's."""
        self.docs.append((doc_id, n))

    def block_ids(self) -> int:
        return self.n_ids - self.block_first

    def end_block(self) -> int:
        """Write the documents since the last block; returns how many ids they have."""
        n = self.block_ids()
        named = np.array([d is not None for d, _ in self.docs], np.uint8)
        doc_ids = np.array([d or 0 for d, _ in self.docs], np.int64).view(np.uint64)
        lengths = np.array([k for _, k in self.docs], np.uint64)
        self.blocks.append([len(self.docs), self.block_first, *(self._put(x) for x in (named, doc_ids, lengths))])
        self.docs, self.block_first = [], self.n_ids
        return n

    def close(self) -> None:
        if self.n_held:
            self.chunks.append([self.n_held, *self._put(np.concatenate(self.held))])
        index = zstandard.compress(json.dumps({"kind": self.kind, "chunk": self.chunk, "n_ids": self.n_ids, "chunks": self.chunks, "blocks": self.blocks}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class Reader:
    """Range reads of one file: the index first, then only the chunks and blocks asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < 2 * len(MAGIC) + 8 or file.read_at(len(MAGIC), 0) != MAGIC or (tail := file.read_at(16, size - 16))[8:] != MAGIC:
            raise ValueError("not a file of id planes")
        length = struct.unpack("<Q", tail[:8])[0]
        index = json.loads(zstandard.decompress(file.read_at(length, size - 16 - length)))
        self.kind, self.chunk, self.n_ids, self.chunks, self.blocks = (index[k] for k in ("kind", "chunk", "n_ids", "chunks", "blocks"))

    def _get(self, place: list[int], n: int, dtype: str) -> np.ndarray:
        at, *lengths = place
        data = self.file.read_at(sum(lengths), at)
        cuts = np.cumsum([0, *lengths]).tolist()
        return from_planes([data[a:b] for a, b in zip(cuts, cuts[1:])], n, dtype, self.kind)

    def stretches(self, first: int, last: int) -> Iterator[np.ndarray]:
        """The ids from `first` to before `last`, a chunk at a time."""
        for k in range(first // self.chunk, -(-last // self.chunk)):
            n, *place = self.chunks[k]
            begin = k * self.chunk
            yield self._get(place, n, "uint32")[max(0, first - begin) : last - begin]

    def documents(self, block: int) -> list[tuple[int | None, int, int]]:
        """(doc_id, first id, ids) of each document of a block."""
        n, first, *places = self.blocks[block]
        named, doc_ids, lengths = (self._get(p, n, t) for p, t in zip(places, ("uint8", "uint64", "uint64")))
        ends = first + np.cumsum(lengths.astype(np.int64))
        return [(d if here else None, e - k, k) for here, d, e, k in zip(named.tolist(), doc_ids.view(np.int64).tolist(), ends.tolist(), lengths.tolist())]

    def block(self, block: int) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id, ids, crc32 of the ids as little-endian 32-bit integers); each chunk is read once."""
        docs = self.documents(block)
        if not docs:
            return
        at, crc, k = docs[0][1], 0, 0
        for ids in self.stretches(docs[0][1], docs[-1][1] + docs[-1][2]):
            data = ids.astype("<u4", copy=False).tobytes()
            begin = at
            at += len(ids)
            while k < len(docs) and docs[k][1] + docs[k][2] <= at:
                doc_id, first, n = docs[k]
                yield doc_id, first, n, zlib.crc32(data[4 * max(0, first - begin) : 4 * (first + n - begin)], crc)
                crc, k = 0, k + 1
            if k < len(docs):
                crc = zlib.crc32(data[4 * max(0, docs[k][1] - begin) :], crc)


# --- encoding --------------------------------------------------------------------------------------------------


def at_blanks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units, each place's unit, places of each text) of texts whose blanks all are stable places, cut there."""
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    ends, words = words.offsets.to_numpy(), words.flatten()
    coded, first = words.dictionary_encode(), words.take(pa.array(ends[:-1])).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    at[ends[:-1]] = len(coded.dictionary) + first.indices.to_numpy()  # no blank stands before a text's first
    units = pa.chunked_array([pc.binary_join_element_wise(pa.scalar(" ", words.type), coded.dictionary, pa.scalar("", words.type)), first.dictionary])
    return units.to_numpy().tolist(), at, np.diff(ends)


def at_places(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same of any texts, cut at all stable places."""
    cut = [_PLACES.split(t) for t in texts]
    coded = pa.array([u for units in cut for u in units], pa.large_string()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.array([len(units) for units in cut])


class Encoder:
    """Ids of texts as the library gives them. Texts are cut into units; each unit that is new goes
    through the library, once while it is remembered. Units met since the last turn are `known`, those of
    the turn before are `older`: what is met often stays."""

    def __init__(self, path: str):
        self.tool = tokens.tokenizer(path)
        added = {t.content for t in self.tool.get_added_tokens_decoder().values()}
        spelt = self.tool.get_vocab(with_added_tokens=True)
        #: Bytes of each token: byte-level tokens have a character for each.
        self.widths = np.zeros(max(spelt.values()) + 1, np.int64)
        self.widths[[*spelt.values()]] = [len(t.encode()) if t in added else len(t) for t in spelt]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def joined(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that may stand one after the other (see _JOINABLE), as one text through the library; the
        tokens' bytes tell them apart. Nothing if these don't add up."""
        ids = np.array(self.tool.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
        token_ends, ends = np.cumsum(self.widths[ids]), np.cumsum([len(u.encode()) for u in units])
        at = np.searchsorted(token_ends, ends)
        if not len(ids) or token_ends[-1] != ends[-1] or (token_ends[at] != ends).any():
            return {}
        cuts, data = (4 * at + 4).tolist(), ids.tobytes()
        return {u: data[a:b] for u, a, b in zip(units, [0, *cuts], cuts)}

    def fresh(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of units through the library."""
        units = [*units]
        plain = [u for u in units if _JOINABLE.fullmatch(u)]
        found: dict[str, bytes] = {}
        for at in range(0, len(plain), JOINED):
            found |= self.joined(plain[at : at + JOINED])
        rest = [u for u in units if u not in found]
        return found | {u: np.array(e.ids, "<u4").tobytes() for u, e in zip(rest, self.tool.encode_batch_fast(rest, add_special_tokens=False))}

    def lookup(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        if len(self.known) > KNOWN_UNITS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = [u for u in units if u not in known]
        known |= {u: older[u] for u in new if u in older}
        known |= self.fresh(u for u in new if u not in known)
        out = [*map(known.__getitem__, units)]
        for unit in new:
            if len(unit) > KNOWN_CHARS:
                del known[unit]
        return out

    def cut_texts(self, units: list[str], at: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that are counts of the units `at`."""
        each = self.lookup(units)
        sizes = np.array([len(x) // 4 for x in each], np.int64)
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        pool = np.frombuffer(b"".join(each), "<u4")
        ids = pool[np.arange(lengths.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - lengths), lengths)]
        return np.split(ids, ends[np.cumsum(counts) - 1][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, or of a stretch of one that begins and ends at its ends or stable places."""
        out: list = [None] * len(texts)
        loose = [_UNSTABLE.search(t) is not None for t in texts]
        for cut, kind in ((at_blanks, False), (at_places, True)):
            some = [k for k, is_loose in enumerate(loose) if is_loose is kind]
            for k, ids in zip(some, self.cut_texts(*cut([texts[k] for k in some])) if some else ()):
                out[k] = ids
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(tool: Encoder, texts: Iterable[str], stretch: int = STRETCH, together: int = TOGETHER) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(number of the text, whether this ends it, ids): long texts come in several parts, so that memory
    holds about `together` characters' worth of units, whatever the lengths."""
    held, size = [], 0

    def done():
        for (k, last, _), ids in zip(held, tool.encode([t for _, _, t in held])):
            yield k, last, ids

    for k, text in enumerate(texts):
        at = tokens.splices(text, stretch)
        for a, b in zip(at, at[1:]):
            held.append((k, b == len(text), text[a:b]))
            size += b - a
            if size >= together:
                yield from done()
                held, size = [], 0
    if held:
        yield from done()


# --- the job ---------------------------------------------------------------------------------------------------


def _write(path: str, folder: str, planes: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, (fs, root) = encoder(path), file_system(folder)
        fs.create_dir(root, recursive=True)
        part, seq, name, writer = TaskContext.get().partitionId(), 0, None, None
        end, rows = np.array([end_id], np.uint32), []

        def block() -> None:
            nonlocal seq
            n = writer.end_block()
            rows.append((part, seq, name, len(writer.blocks) - 1, n))
            seq += 1

        def flush():
            out = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["part", "seq", "file", "block", "n_ids"])

        for batch in pieces(batches, size=TOGETHER):
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = 0
            for k, last, ids in encode_texts(tool, texts):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.idp"
                    writer = Writer(fs.open_output_stream(f"{root}/{name}"), planes)
                writer.ids(ids)
                n += len(ids)
                if last:
                    writer.ids(end)
                    writer.document(doc_ids[k], n + 1)
                    n = 0
                    if writer.block_ids() >= BLOCK_IDS or len(writer.docs) >= BLOCK_DOCS:
                        block()
                        if writer.n_ids >= file_ids:
                            writer.close()
                            writer = None
            if rows:
                yield flush()
        if writer is not None:
            if writer.docs:
                block()
            writer.close()
        if rows:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, folder: str, planes: str = PLANES, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """docs (doc_id, text) -> files of id planes in `folder`, in ascending order of doc_id, and a row for each document block.

    Rows are dealt out by ranges of doc_id (null first), then a hash of the text, then the place where they
    were read, so that even one doc_id with most of the rows is spread over tasks. Each task writes files
    under names of its own; those of a task that ran twice are in no row of what is returned, once it is written.
    """
    small_batches(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_place")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_place"))
    dealt = rows.repartitionByRange(spread(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(_write(path, folder, planes, end_id, file_ids), BLOCKS)


def read_blocks(blocks: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in blocks (file, block, before), read from the files;
    before says how many ids stand before a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name = file = reader = None
        for batch in batches:
            for at, block, before in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "before"))):
                if at != name:
                    if file is not None:
                        file.close()
                    name, file = at, fs.open_input_file(f"{root}/{at}")
                    reader = Reader(file)
                more = before - reader.blocks[block][1]
                rows = [(d, more + first, n, crc) for d, first, n, crc in reader.block(block)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if file is not None:
            file.close()

    near = blocks.select("file", "block", "before").repartition(spread(blocks.sparkSession), "file", "block").sortWithinPartitions("file", "block")
    return near.mapInArrow(run, DOCS)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, seq, before): ids of all blocks before each one, summed within parts, then over the parts' totals,
    of which there are as many as writing tasks."""
    def earlier(n: str, order: str, *keys: str):
        return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    inside = blocks.select("part", "seq", earlier("n_ids", "seq", "part").alias("inside"))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", earlier("n", "part").alias("earlier"))
    return inside.join(parts, "part").select("part", "seq", (F.col("earlier") + F.col("inside")).alias("before"))


def token_files(docs: DataFrame, path: str, planes: str = PLANES, file_ids: int = FILE_IDS) -> DataFrame:
    """docs (doc_id, text, any more) -> (doc_id, start, n_tokens, ids_crc32) as read back from files of id planes.

    Every text's ids, as the library gives them, and END_ID stand in ascending order of doc_id, null first,
    rows of equal doc_id by a hash of the text; equal rows are interchangeable and stand each. start counts
    the ids of all documents before. Null texts count as empty: END_ID alone. Very long texts are encoded
    in stretches, their ids written by chunks. Columns of any other name are never read; an empty table
    gives an empty one. Texts shuffle once; files and their list of blocks stand in the shared folder
    before anything is read back, so that a lost executor costs only running tasks. Reading deals out
    blocks of about BLOCK_IDS ids, not files; only
    the list of blocks is ever joined.
    """
    folder = scratch(docs.sparkSession, "id-planes")
    file_system(folder)
    blocks = settle(write_ids(docs, path, folder, planes, file_ids=file_ids), "id-blocks")
    return read_blocks(blocks.join(block_starts(blocks), ["part", "seq"]), folder)
