"""Scans S3, S4, S9, S10 and files K3; S1, S2 and K1 are in snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normalise_prefix
from .shared_dir import settle, store_uri
from .snapshots import read_manifest, versions, write_snapshot  # noqa: F401


def lookup(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """S3: all keys at once, as one join on path."""
    return keys.select("path").distinct().join(manifest, "path")


#: Rows, and bytes of bodies, that a batch of a listing or of files read holds about.
ROWS, BYTES = 5000, 16 << 20


def _listed(spark: SparkSession, base: str) -> DataFrame:
    """(path, length) of all files below a folder.

    The directories of each level are dealt out to tasks, which list one after the other, and what they find is written:
    neither files nor directories pass through the driver, as they do in a scan of Spark's own, which lists its folder
    before it reads. A directory's own entries are one call of its store. As many steps as the tree is deep.
    """
    uri = store_uri(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        root, rows = root.rstrip("/"), []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for e in store.get_file_info(fs.FileSelector(f"{root}{folder}" or "/")):
                    if e.type in (fs.FileType.File, fs.FileType.Directory):
                        rows.append({"path": f"{folder}/{e.base_name}", "length": e.size, "is_dir": e.type == fs.FileType.Directory})
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _LISTED)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _LISTED)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.range(1).select(F.lit("").alias("path")), []
    while not files or not level.isEmpty():
        found = settle(level.repartition(parts, "path").mapInArrow(run, "path string, length long, is_dir boolean"), "listed")
        files.append(found.where("NOT is_dir").select("path", "length"))
        level = found.where("is_dir").select("path")
    return reduce(DataFrame.unionByName, files)


_LISTED = pa.schema({"path": pa.string(), "length": pa.int64(), "is_dir": pa.bool_()})
_BODIES = pa.schema({"path": pa.string(), "content": pa.binary()})


def read_pointers(spark: SparkSession, base: str) -> DataFrame:
    """(path, content) of all pointer files below a folder; they are dealt out before they are read."""
    uri = store_uri(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        root, rows, held = root.rstrip("/"), [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{root}{path}", compression=None) as file:
                    rows.append({"path": path, "content": file.read()})
                held += len(rows[-1]["content"])
                if len(rows) == ROWS or held >= BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _BODIES)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _BODIES)

    paths = _listed(spark, base).where(F.col("path").endswith(".strm")).select("path")
    dealt = paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(run, "path string, content binary").withColumn("content", F.col("content").cast("string"))


def write_files(files: DataFrame, base: str) -> DataFrame:
    """K3: write each row (target, content) as a file of its own below a folder that all executors see; (target, length).

    Nothing is written before an action on the result. A task that runs again writes the same files anew.
    """
    uri = store_uri(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            sizes = []
            for target, content in zip(batch.column("target").to_pylist(), batch.column("content").to_pylist()):
                data = content.encode()
                store.create_dir(f"{root}{target.rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{root}{target}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"target": batch.column("target"), "length": pa.array(sizes, pa.int64())})

    return files.where("content IS NOT NULL").select("target", "content").mapInArrow(run, "target string, length long")


def read_skip_list(spark: SparkSession, file: str) -> DataFrame:
    """(prefix) of the lines that name one."""
    return spark.read.text(file).select(normalise_prefix(F.col("value")).alias("prefix")).where("prefix IS NOT NULL").distinct()


def stored_files(spark: SparkSession, base: str) -> DataFrame:
    """(path, length) of the files below a folder; bodies are not read."""
    return _listed(spark, base)
