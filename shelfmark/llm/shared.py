"""What the operators have in common: written tables, Arrow text as numpy bytes, hashes, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared_dir import Shelf, file_system, scratch, settle  # noqa: F401

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one numpy step handles; temporary arrays take about 50 times as much.
PIECE = 1 << 19
#: Bytes from which an Arrow batch takes no more rows.
BATCH_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def spread(spark: SparkSession) -> int:
    """Partitions for a repartition by key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts travel in Arrow batches: keep these small so that long documents don't add up.

    Rows are never cut: one that is longer than BATCH_BYTES is a batch of its own. The two settings stay,
    since plans read them when they run; they change the size of batches, never a result.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (with the end as last); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text, at least a row each; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1 : column.offset + len(column) + 1]
        start = 0
        before = ends[0] - len(column[0].as_py().encode())
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            before, start = ends[stop - 1], stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 0x20, data)


def word_table(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the number of words) of the runs of `inside`, cut at text ends."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


#: Tasks whose counts meet in one group when counts are summed in levels.
FAN = 6


def _sum_of(dtype: str):
    def run(table: pa.Table) -> pa.Table:
        rows = table.column("counts")
        total = np.zeros(len(rows[0].as_buffer()) // np.dtype(dtype).itemsize, np.int64)
        for row in rows:
            total += np.frombuffer(row.as_buffer(), dtype)
        return table.slice(0, 1).set_column(table.column_names.index("counts"), "counts", pa.array([total.tobytes()], table.schema.field("counts").type))

    return run


def summed(rows: DataFrame, keys: tuple[str, ...], dtype: str) -> DataFrame:
    """rows (keys, task int, counts: an array of `dtype` as bytes) -> (keys, counts as int64), added up for each key.

    In three levels by task number, so that no group holds the arrays of more than 2 ** FAN tasks
    until there are more than 2 ** (3 * FAN) of them.
    """
    for shift in (FAN, FAN, 31):
        rows = rows.withColumn("task", F.shiftright("task", shift).cast("int"))
        rows = rows.groupBy(*keys, "task").applyInArrow(_sum_of(dtype), rows.schema)
        dtype = "int64"
    return rows.drop("task")


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b) -> (node, root) for each node on an edge; nodes share a root iff edges connect them.

    Contraction: each node points to its smallest neighbour, pointers are followed twice more, edges
    are mapped to their ends' targets and only those between different ones remain. Each round is
    written out, its size is all that the driver sees, and the tables of the round before go. Groups are
    summed by partial aggregates, a node with very many edges meets only joins that adaptive execution
    can split.
    """
    shelf = Shelf(edges.sparkSession, name)
    edges = shelf.put(edges.where("a <> b").select("a", "b").distinct(), "edges")
    root = None
    rounds = 0
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        to = shelf.put(both.groupBy("node").agg(F.min("to").alias("low")).select("node", F.least("node", "low").alias("to")), f"to{rounds}")
        for _ in range(2):
            follow = to.select(F.col("node").alias("to"), F.col("to").alias("then"))
            to = to.join(follow, "to").select("node", F.col("then").alias("to"))
        to = shelf.put(to, f"jump{rounds}")
        if root is None:
            root = to.withColumnRenamed("to", "root")
        else:
            root = root.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        root = shelf.put(root, f"root{rounds}")
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("c")), to.select(F.col("node").alias("b"), F.col("to").alias("d"))
        edges = shelf.put(edges.join(a, "a").join(b, "b").where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), f"edges{rounds}")
        shelf.drop(f"to{rounds}", f"jump{rounds}", *([f"root{rounds - 1}", f"edges{rounds - 1}"] if rounds else ["edges"]))
        rounds += 1
        if edges.isEmpty():
            return root


def joined_components(root: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of components with more edges (a, b): only the components that these touch are worked on."""
    a, b = root.select(F.col("node").alias("a"), F.col("root").alias("c")), root.select(F.col("node").alias("b"), F.col("root").alias("d"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    moved = components(between, name)
    known = root.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return settle(known.unionByName(moved.join(root.select("node"), "node", "left_anti")), f"{name}-joined")
