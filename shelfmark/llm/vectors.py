"""Operator 2: embedding near-dedup by collision-counting projections."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Shelf, components, mix, spread

COSINE = 0.9
#: Cell width of the projections that a band nests, and half width of a query's window on sorted and counted projections.
CELL, WINDOW = 1.8, 0.9
#: Places on sorted projections are whole numbers, so that all decide alike what lies in a window: steps of a unit,
#: half width of a window, and width of the slabs that a sorted projection is dealt out in.
STEPS = 1 << 20
REACH = round(WINDOW * STEPS)
SLAB = 4 * REACH
#: Unlike vectors that a band may leave together with a vector: more vectors nest more projections.
MATES = 64
#: Share of pairs at exactly the least cosine that the bands should bring together.
RECALL = 0.975
#: Projections whose collisions are counted, and the share of pairs at exactly the least cosine that the count lets pass.
COUNTED, COUNT_RECALL = 24, 0.995
#: Vectors of a block: larger groups are dealt out as pairs of blocks.
BLOCK = 256
SEED = 20240229


def _same_cell(distance: float, width: float) -> float:
    """Chance that projections of two points at a distance fall into one cell of a random grid."""
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def _in_window(distance: float) -> float:
    """Chance that one point's projection lies in the window centred on the other's."""
    return erf(WINDOW / distance / sqrt(2))


def calibrate(n: int, cosine: float = COSINE) -> tuple[int, int, int]:
    """(nested projections, bands, least count) for n vectors that reach RECALL and COUNT_RECALL for pairs at just this
    cosine; closer pairs have more. Unlike vectors are taken to be at right angles."""
    near, far = sqrt(2 - 2 * cosine), sqrt(2)
    nested = max(1, ceil(log(max(n * _in_window(far) / MATES, 1)) / -log(_same_cell(far, CELL))))
    bands = ceil(log(1 - RECALL) / log(1 - _same_cell(near, CELL) ** nested * _in_window(near)))
    inside = _in_window(near)
    least = max(k for k in range(COUNTED + 1) if sum(comb(COUNTED, j) * inside**j * (1 - inside) ** (COUNTED - j) for j in range(k, COUNTED + 1)) >= COUNT_RECALL)
    return nested, bands, least


class Planes:
    """Random projections of vectors of one length: for each band `nested` that are cut into cells and one that is
    sorted, and COUNTED further ones."""

    def __init__(self, dim: int, nested: int, bands: int):
        rng = np.random.default_rng(SEED)
        self.dim, self.nested, self.bands = dim, nested, bands
        self.cut, self.shift = rng.standard_normal((dim, bands * nested)), rng.uniform(0, CELL, bands * nested)
        self.sort, self.counted = rng.standard_normal((dim, bands)), rng.standard_normal((dim, COUNTED))
        self.odd = (mix(np.arange(1, nested + 1, dtype=np.uint64)) | np.uint64(1)).reshape(1, 1, -1)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """For each vector and band, a key of the cell that the nested projections fall into."""
        grid = np.floor((unit @ self.cut + self.shift) / CELL).astype(np.int64).view(np.uint64).reshape(-1, self.bands, self.nested)
        return (mix((grid * self.odd).sum(2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(data: bytes, dtype: str, dim: int) -> np.ndarray:
    x = np.frombuffer(data, dtype).astype(np.float64).reshape(-1, dim)
    unit = x / np.abs(x).max(1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _place(planes: Planes, dtype: str):
    """Each vector's bytes, and for each band its cell and its place on the sorted projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, planes.dim)
            unit = _unit(x.tobytes(), dtype, planes.dim)
            cells, places = planes.cells(unit), np.round((unit @ planes.sort) * STEPS).astype(np.int32)
            ends = pa.array(np.arange(0, cells.size + 1, planes.bands), pa.int32())
            yield pa.RecordBatch.from_pydict({"cls": batch.column("cls"), "copies": batch.column("copies"), "vector": pa.array([r.tobytes() for r in x], pa.binary()), "keys": pa.array([r.tobytes() for r in np.concatenate((cells, places), 1)], pa.binary()), "cells": pa.ListArray.from_arrays(ends, pa.array(cells.reshape(-1))), "places": pa.ListArray.from_arrays(ends, pa.array(places.reshape(-1)))})

    return run


def _windows(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of two lists of places in order, all (i, j) of which j lies in the window centred on i; i < j if both lists are one."""
    first = np.arange(1, len(left) + 1) if same else np.searchsorted(right, left - REACH, "left")
    last = np.searchsorted(right, left + REACH, "right")
    n = np.maximum(last - first, 0)
    start = np.concatenate(([0], np.cumsum(n)))
    i = np.repeat(np.arange(len(left)), n)
    return i, np.arange(start[-1]) - np.repeat(start[:-1] - first, n)


GROUP = ["band", "cell", "slab", "one", "two"]


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Of the edges between a and b those of a spanning forest."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = up
        return x

    out = []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            top[q] = p
            out.append((x, y))
    return out


def _collide(planes: Planes, least: int, cosine: float, dtype: str):
    """Links inside each (band, cell, slab, block pair): partial link counts, and enough edges to connect what is linked.

    Rows come sorted by group and by their place on the band's sorted projection. Pairs are those in a
    query's window there; of each the collisions on the counted projections are counted, and pairs
    with enough of them are verified. A pair counts in the first band that brings it together, so
    that no pair is told twice and none has to be shuffled. Of the links a spanning forest goes out.
    The groups that a batch completes are handled at once.
    """

    def links(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
        col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        same, side = col("one") == col("two"), col("side")
        # groups are lifted apart, so that one search serves all
        place = (group.astype(np.int64) << 40) + col("place")
        whole, left, right = np.flatnonzero(same), np.flatnonzero(~same & (side == 0)), np.flatnonzero(~same & (side == 1))
        (i, j), (k, m) = _windows(place[whole], place[whole], True), _windows(place[left], place[right], False)
        i, j = np.concatenate((whole[i], left[k])), np.concatenate((whole[j], right[m]))
        if not len(i):
            return None
        unit = _unit(b"".join(batch.column("vector").to_pylist()), dtype, planes.dim)
        where = (unit @ planes.counted).T.copy()
        hits = np.zeros(len(i), np.uint8)
        for row in where:
            hits += np.abs(row[i] - row[j]) <= WINDOW
        found = hits >= least
        i, j = i[found], j[found]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int32).reshape(-1, 2, planes.bands).astype(np.int64)
        met = (keys[i, 0] == keys[j, 0]) & (np.abs(keys[i, 1] - keys[j, 1]) <= REACH) & (np.arange(planes.bands) < col("band")[i][:, None])
        fresh = ~met.any(1)
        i, j = i[fresh], j[fresh]
        cls, copies = col("cls"), col("copies")
        counts = np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))
        edges = _forest(cls[i].tolist(), cls[j].tolist())
        some = np.flatnonzero(counts)
        return pa.RecordBatch.from_pydict({"cls": pa.array([a for a, _ in edges] + cls[some].tolist(), pa.int64()), "to": pa.array([b for _, b in edges] + [None] * len(some), pa.int64()), "links": pa.array([0] * len(edges) + counts[some].astype(np.int64).tolist(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            group = _groups(batch)
            last = int(np.searchsorted(group, group[-1]))
            rest = batch.slice(last)
            out = links(batch.slice(0, last), group[:last]) if last else None
            if out is not None:
                yield out
        if rest is not None and (out := links(rest, _groups(rest))) is not None:
            yield out

    return run


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """Number of each row's group, from 0 on."""
    new = np.zeros(batch.num_rows, bool)
    for c in GROUP:
        x = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _dealt(placed: DataFrame) -> DataFrame:
    """Narrow rows (band, cell, slab, one, two, side, place, cls): who meets whom.

    A slab's vectors meet each other (in pairs of blocks, if there are more than a block) and those at
    the begin of the next slab that a window can reach; those meet nobody else here.
    """
    rows = placed.select("cls", F.posexplode(F.arrays_zip("cells", "places")).alias("band", "k")).select("cls", "band", F.col("k.cells").alias("cell"), F.col("k.places").alias("place"))
    rows = rows.withColumn("slab", F.floor(F.col("place") / SLAB))
    reach = F.col("place") - F.col("slab") * SLAB <= REACH
    rows = rows.withColumn("own", F.explode(F.when(reach, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))).withColumn("slab", F.when(F.col("own"), F.col("slab")).otherwise(F.col("slab") - 1))
    sizes = rows.groupBy("band", "cell", "slab").agg(F.count_if("own").alias("few"), F.count_if(~F.col("own")).alias("many")).where("few > 0 AND few + many > 1")
    sizes = sizes.select("band", "cell", "slab", F.ceil(F.col("few") / BLOCK).alias("few"), F.ceil(F.col("many") / BLOCK).alias("many"))
    rows = rows.join(sizes, ["band", "cell", "slab"])
    hashed = F.xxhash64("cls", "band")
    rows = rows.withColumn("mine", F.when(F.col("own"), F.pmod(hashed, F.col("few"))).otherwise(F.col("few") + F.pmod(hashed, F.col("many"))))
    to = F.sequence(F.lit(0).cast("long"), F.when(F.col("own"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    deal = F.transform(to, lambda x: F.struct(F.least(x, F.col("mine")).alias("one"), F.greatest(x, F.col("mine")).alias("two"), F.when(x < F.col("mine"), 1).otherwise(0).alias("side")))
    return rows.select("band", "cell", "slab", "place", "cls", F.explode(deal).alias("d")).select("band", "cell", "slab", "place", "cls", "d.*")


def vector_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors (vec_id, embedding, any more) -> vec_id, n_links, component_id, kept.

    Equal vectors are one class with a number of copies; copies link among themselves without being
    paired. Many random one-dimensional projections are sorted. On each the pairs in a query-centred
    window collide; the pairs' collisions on further projections are counted, and pairs with enough of
    them are verified by their cosine in double precision. As a window on one projection holds a
    fixed share of all vectors, each sorted projection is taken within the cells of nested ones (a
    band), the more of these the more vectors there are, so that a window holds some MATES unlike
    vectors at any size. Numbers of nested projections, bands and collisions are calibrated for pairs
    at exactly `cosine` (see calibrate); closer pairs are found more surely. Large groups are dealt
    out as pairs of blocks; only partial counts and spanning edges leave a task.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do
    vectors of different lengths. Repeated vec_ids count as vectors of their own, answered alike; a null
    vec_id stays null, with a component_id as all others. Other columns are never read. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark, "vectors")
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(sound, F.transform("embedding", lambda x: x + F.lit(0.0)))).drop("embedding")
    rows = rows.withColumn("hash", F.when(F.col("vector").isNotNull(), F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256)))
    classes = rows.where("hash IS NOT NULL").groupBy("hash").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("embedding"))
    classes = shelf.put(classes.withColumn("cls", F.xxhash64("hash", F.lit(SEED))), "classes")
    parts = []
    for dim, n in classes.groupBy(F.size("embedding")).count().collect():
        nested, bands, least = calibrate(n, cosine)
        planes = Planes(dim, nested, bands)
        some = classes.where(F.size("embedding") == dim).select("cls", "copies", "embedding")
        placed = shelf.put(some.mapInArrow(_place(planes, dtype), "cls long, copies long, vector binary, keys binary, cells array<int>, places array<int>"), f"placed{dim}")
        dealt = shelf.put(_dealt(placed), f"dealt{dim}").join(placed.select("cls", "copies", "vector", "keys"), "cls")
        dealt = dealt.repartition(spread(spark), *GROUP).sortWithinPartitions(*GROUP, "place")
        parts.append(shelf.put(dealt.mapInArrow(_collide(planes, least, cosine, dtype), "cls long, to long, links long"), f"found{dim}"))
        shelf.drop(f"dealt{dim}", f"placed{dim}")
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    linked = found.where("to IS NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    root = components(found.where("to IS NOT NULL").select(F.col("cls").alias("a"), F.col("to").alias("b")), "vectors")
    named = classes.select("hash", "cls", "low", "copies").join(linked, "cls", "left").join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    named = named.select("hash", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "hash").join(named, "hash", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
