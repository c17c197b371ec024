"""Operator 4: media columns. Content-addressed payloads in tar shards, rows with digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, scratch, settle, small_batches, spread

#: Samples of a row of the image; a payload is whole rows, the last one filled with blanks.
WIDTH, BLANK = 192, b" "
#: Bytes of a shard before the next one begins, and of the ranges that one read-back task key spans.
SHARD, RANGE = 256 << 20, 16 << 20
LEVEL = 6
BLOCK = tarfile.BLOCKSIZE
MAGIC = b"\x89PNG\r\n\x1a\n"
#: Bytes from a file's begin that hold its header: magic and the IHDR chunk.
HEADER = 33
CATALOG = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, least int, most int, total long"
HEAD = "digest string, width long, height long, bit_depth int, colour_type int"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the bytes with blanks up to a positive multiple of WIDTH)."""
    data = (text or "").encode()
    return len(data), data + BLANK * (WIDTH - len(data) if not data else -len(data) % WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, WIDTH wide, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of a file that to_png wrote."""
    width, height, _, _ = png_header(data)
    at, body = HEADER, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class Shards:
    """Tar files that one task writes, each under a name of its own, so that a task run again never
    meets the files of its earlier run. A payload is stored once in a shard."""

    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.name, self.at, self.seen = None, "", 0, {}

    def put(self, digest: str, make) -> tuple[str, int, int]:
        if self.out is not None and self.at > SHARD:
            self.close()
        if self.out is None:
            self.name, self.at, self.seen = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        if digest not in self.seen:
            data = make()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % BLOCK))
            self.seen[digest] = self.name, self.at + BLOCK, len(data)
            self.at += BLOCK + len(data) + -len(data) % BLOCK
        return self.seen[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 2 * BLOCK)
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of docs (doc_id, text) into tar shards in `folder`; rows say where each one is.

    Texts never shuffle: each task writes what it scans. Equal texts in different tasks are stored by
    each of these at most; `index` then gives all of them one place.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder)
        for batch in pieces(batches):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "digest", "shard", "offset", "length")}
            for text in batch.column("text").to_pylist():
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                shard, offset, length = shards.put(digest, lambda: to_png(payload))  # noqa: B023
                for k, v in zip(out, (n, digest, shard, offset, length)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})
        shards.close()

    return docs.select("doc_id", "text").mapInArrow(run, CATALOG)


def index(catalog: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): the one place of each payload."""
    return catalog.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _in_order(places: DataFrame) -> DataFrame:
    """Places dealt out by ranges of their shards, in order of offset: a task reads neighbours one after the other."""
    near = F.floor(F.col("offset") / RANGE)
    return places.repartition(spread(places.sparkSession), "shard", near).sortWithinPartitions("shard", "offset")


class Reader:
    """Range reads of the shards in a folder; the last one stays open."""

    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name, self.file = None, None


def _reads(folder: str, schema: str, row):
    """Rows (digest, *row(reader, shard, offset, length)) of each place."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            rows = [(digest, *row(reader, *at)) for digest, *at in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")))]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(fields), fields)], schema=fields)
        reader.close()

    return run


def _header(reader: Reader, shard: str, offset: int, length: int) -> tuple[int, int, int, int]:
    return png_header(reader.read(shard, offset, HEADER))


def _content(reader: Reader, shard: str, offset: int, length: int) -> tuple:
    media = reader.read(shard, offset, length)
    payload = from_png(media)
    samples = np.frombuffer(payload, np.uint8)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), int(samples.min()), int(samples.max()), int(samples.sum(dtype=np.int64))


def headers(places: DataFrame, folder: str) -> DataFrame:
    """Metadata columns (digest, width, height, bit_depth, colour_type) from range reads of HEADER bytes, without the payloads."""
    return _in_order(places.select("digest", "shard", "offset", "length")).mapInArrow(_reads(folder, HEAD, _header), HEAD)


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """Digests and sums of the stored files' samples, read by ranges of their shards in order of offset."""
    return _in_order(places.select("digest", "shard", "offset", "length")).mapInArrow(_reads(folder, READ, _content), READ)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> a row for each document with digests and features of its stored payload.

    The shards and the catalog stand in the shared folder before anything is read back, so an executor
    lost later costs no payload; what a task that ran again had written before is in no row of the
    catalog. A payload is stored once in a task's shard; where several tasks met it, the index gives all
    rows one place, and only that is read. Metadata columns come from header-only reads, all else from
    a payload decoded once; both join the rows by digest, where adaptive execution splits the rows of a
    digest that many share. Null texts count as empty, which is one row of blanks; equal texts give equal
    values, repeated rows a row each, null doc_ids stay null; other columns are never read; an empty
    table gives an empty one.
    """
    folder = scratch(docs.sparkSession, "media")
    catalog = settle(store(docs, folder), "media-catalog")
    places = settle(index(catalog), "media-index")
    features = read_back(places, folder).join(headers(places, folder), "digest")
    feature = F.format_string("png:%dx%d:%d:%d:min=%d:max=%d:sum=%d", "width", "height", "bit_depth", "colour_type", "least", "most", "total")
    rows = catalog.select("doc_id", "n_bytes", "digest").join(features, "digest")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", "bit_depth")
