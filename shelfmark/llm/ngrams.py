"""Operator 1: n-gram Jaccard join. Rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shelf, components, joined_components, lower, mix, pieces, small_batches, spaces, spread, summed, utf8, word_hashes, word_table

#: Words of a shingle, and the similarity in hundredths from which documents link.
WORDS = 5
SIMILAR, PARTS = 80, 100
#: Cells (a power of two) of the table of shingle frequencies, in slices that are summed apart. Four bytes a cell
#: go to every task; more cells tell rare shingles apart in corpora of far more than a million documents.
CELL_BITS, SLICES = 20, 16
#: A shingle is hot if its cell counts more documents than this, and than this many times the mean of all cells. What
#: is not hot has no more rows than that, a fixed share of all at any size, and may stand in one task.
HOT, HOT_MEANS = 1 << 12, 8
#: Ranges of the shingle order whose counts the suffix filter compares, at least, and shingles of a range on average,
#: at most: long documents have as many more ranges.
RANGES, IN_RANGE = 128, 4
#: Rounds in which every class is verified with the nearest of other components, before all remaining pairs are.
ROUNDS = 2
#: Classes of a block: the classes of a shingle that more share are dealt out as pairs of blocks.
BLOCK = 512
#: Bits of a slice, and of the whole table at most, that tells which rows surely stay (powers of two).
SLICE_BITS, MOST_BITS = 1 << 17, 1 << 28
#: Names of sets: a class goes by the first 64 bits of a digest, the next 64 tell sets apart that agree in these.
NAME_BITS = 64


@dataclass(frozen=True)
class Likeness:
    """What links: sets of shingles of `words` words with PARTS * intersection >= similar * union."""

    words: int = WORDS
    similar: int = SIMILAR

    def prefix_size(self, n: int) -> int:
        """Shingles of a set of n of which any set similar enough shares one."""
        return n - -(-self.similar * n // PARTS) + 1

    def sizes_fit(self, least, most):
        """Length filter."""
        return PARTS * least >= self.similar * most

    def overlap_fits(self, most, sizes):
        """Positional filter: `most` shingles can be common to two sets of `sizes` in sum."""
        return (PARTS + self.similar) * most >= self.similar * sizes

    def ranges_fit(self, apart, sizes):
        """Suffix filter: counts by range differ by `apart` in sum."""
        return (PARTS + self.similar) * apart <= (PARTS - self.similar) * sizes

    def links(self, shared: int, sizes: int) -> bool:
        return PARTS * shared >= self.similar * (sizes - shared)


def shingle_arrays(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; a text of fewer words is one shingle."""
    data, at = utf8(texts)
    data = lower(data)
    start, end, first = word_table(~spaces(data), at)
    words = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    factors = [mix(np.full(1, k + 1, np.uint64))[0] | np.uint64(1) for k in range(n)]
    every = mix(sum((words[k : len(words) - n + 1 + k] * factors[k] for k in range(n)), np.zeros(max(len(words) - n + 1, 0), np.uint64)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield mix(np.sum(words[a:b] * np.array(factors[: b - a]), keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_names(found: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """(name of the set's class, further 64 bits of the same digest)."""
    digest = hashlib.blake2b(found, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True) >> (64 - bits), int.from_bytes(digest[8:], "little", signed=True)


def _frequencies(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.int32)
    for batch in pieces(batches):
        found = [*shingle_arrays(batch.column("text"), like.words)]
        total += np.bincount(np.concatenate(found) >> np.uint64(64 - CELL_BITS), minlength=len(total)).astype(np.int32)
    if total.any():
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), "counts": [p.tobytes() for p in np.split(total, SLICES)]})


def frequency_table(docs: DataFrame, like: Likeness) -> np.ndarray:
    """How many documents have shingles of each hash cell: all documents count, the size is fixed.

    Cells stand in for shingles only in the order of rarity. Any order common to all documents gives
    the same result; this one moves what many documents share out of their prefixes.
    """
    rows = docs.select("text").mapInArrow(lambda batches: _frequencies(batches, like), "slice int, task int, counts binary")
    table = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.int64)
    for part, counts in summed(rows, ("slice",), "int32").collect():  # SLICES rows
        table[part] = np.frombuffer(bytes(counts), np.int64)
    return np.minimum(table.reshape(-1), (1 << 31) - 1).astype(np.uint32)


def hot_from(table: np.ndarray) -> int:
    """The count of a cell from which its shingles are hot."""
    return max(HOT, int(HOT_MEANS * table.mean())) + 1


def _ranges(found: np.ndarray) -> bytes:
    """Counts by range: two in a byte, and a byte more to tell these apart, or a byte each; none where a byte doesn't
    hold them, which the filter lets pass."""
    bits = RANGES.bit_length() - 1
    while len(found) > IN_RANGE << bits:
        bits += 1
    counts = np.bincount(found >> np.uint64(64 - bits), minlength=1 << bits)
    if counts.max() < 16:
        return (counts[::2] << 4 | counts[1::2]).astype(np.uint8).tobytes() + b"\0"
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _each(ranges: bytes) -> bytes:
    """What _ranges told, a byte each."""
    if len(ranges) % 2 == 0:
        return ranges
    two = np.frombuffer(ranges, np.uint8)[:-1]
    return np.stack((two >> 4, two & 15), 1).tobytes()


class _Counts:
    """Counts by range of some sets: by how much two sets differ in sum, over the ranges of the one that has fewer."""

    def __init__(self, ranges: list[bytes]):
        self.ranges = [_each(r) for r in ranges]
        self.width = np.array([len(r) for r in self.ranges])
        self.folded: dict[int, np.ndarray] = {}

    def at(self, width: int) -> np.ndarray:
        """Counts of all sets with at least so many ranges, in that many; 0 for others."""
        if width not in self.folded:
            out = self.folded[width] = np.zeros((len(self.ranges), width), np.int32)
            for own in {int(w) for w in self.width if w >= width}:
                rows = np.flatnonzero(self.width == own)
                counts = np.frombuffer(b"".join(self.ranges[k] for k in rows.tolist()), np.uint8)
                out[rows] = counts.reshape(len(rows), width, own // width).sum(2)
        return self.folded[width]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of sets; 0 where one has no counts."""
        out = np.zeros(len(j), np.int64)
        widths = np.minimum(self.width[i], self.width[j])
        for width in {int(w) for w in widths if w}:
            counts, some = self.at(width), np.flatnonzero(widths == width)
            out[some] = np.abs(counts[j[some]] - counts[i[some]]).sum(1)
        return out


def _prefixes(table, like: Likeness, bits: int):
    """A row for each document: its key and place, size, names of the set, counts by range, and the rarest shingles in
    order, of which the first `cold` are not hot; of documents of one class in a task only the first has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot = table.value
        seen: set[tuple[int, int]] = set()
        for batch in pieces(batches):
            sizes, names, ranges, prefixes, cold = [], [], [], [], []
            for found in shingle_arrays(batch.column("text"), like.words):
                n = len(found)
                sizes.append(n)
                names.append(set_names(found, bits) if n else (None, None))
                ranges.append(_ranges(found) if n else None)
                if n and names[-1] not in seen:
                    seen.add(names[-1])
                    met = counts[found >> np.uint64(64 - CELL_BITS)]
                    rare = np.argsort(met, kind="stable")[: like.prefix_size(n)]
                    prefixes.append(found[rare].view(np.int64))
                    cold.append(int((met[rare] < hot).sum()))
                else:
                    prefixes.append(np.zeros(0, np.int64))
                    cold.append(0)
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            cls, more = zip(*names)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "digest", "place")}, "n": pa.array(sizes, pa.int64()), "cls": pa.array(cls, pa.int64()), "more": pa.array(more, pa.int64()), "ranges": pa.array(ranges, pa.binary()), "cold": pa.array(cold, pa.int32()), "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))})

    return run


KNOWN = "doc_id long, digest long, place long, n long, cls long, more long, ranges binary, cold int, prefix array<long>"


def _sets(like: Likeness, bits: int):
    """Whole sets of the documents, once for a class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in pieces(batches):
            rows = []
            for found in shingle_arrays(batch.column("text"), like.words):
                if len(found) and (names := set_names(found, bits)) not in seen:
                    seen.add(names)
                    rows.append((*names, found.tobytes()))
            if rows:
                cls, more, members = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(more, pa.int64()), pa.array(members, pa.binary())], ["cls", "more", "members"])

    return run


def _apart(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """Rows whose `cls` stands for several sets are named by `more`, but for the set that comes first."""
    if clash is None:
        return rows
    return rows.join(clash, "cls", "left").withColumn("cls", F.when(F.col("more") > F.col("least"), F.col("more")).otherwise(F.col("cls"))).drop("least")


def _suffix_ok(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Suffix filter: the sets' counts in ranges of the order differ in sum by no more than a linked pair's sets can."""
    for batch in batches:
        if batch.num_rows:
            n = np.arange(batch.num_rows)
            apart = _Counts([*batch.column("ra").to_pylist(), *batch.column("rb").to_pylist()]).apart(n, n + len(n))
            sizes = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            yield batch.select(["a", "b"]).filter(pa.array(like.ranges_fit(apart, sizes)))


def _linked(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("sa"), batch.column("sb")):
            both = np.concatenate((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)))
            both.sort(kind="stable")  # two runs in order
            keep.append(like.links(int((both[1:] == both[:-1]).sum()), len(both)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come sorted by (gram, one, two) -> this key and its rows, two at least."""
    now, rows = None, []
    for batch in batches:
        for gram, one, two, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "one", "two", *names))):
            if (gram, one, two) != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = (gram, one, two), []
            rows.append(row)
    if len(rows) > 1:
        yield now, rows


def _feasible(rows: list[tuple], same: bool, like: Likeness) -> Iterator[tuple[int, np.ndarray]]:
    """Of a shingle's (side, root, n, pos, ...), in order of n, each row number of the left side, and those on the
    right that its class may link with: of another component, with sizes alike, and enough shingles left.

    Sizes in order bound the rows that are looked at.
    """
    if len(rows) == 2:
        (s, r, n, p), (t, q, m, o) = rows[0][:4], rows[1][:4]
        if (same or s != t) and r != q and like.sizes_fit(min(n, m), max(n, m)) and like.overlap_fits(1 + min(n - p - 1, m - o - 1), n + m):
            yield 0, np.array([1])
        return
    side, root, n, pos = np.array([r[:4] for r in rows]).T
    left = np.arange(len(rows)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    sizes, rest = n[right], n - pos - 1
    most = np.searchsorted(sizes, n[left] * PARTS // like.similar, "right")
    least = left + 1 if same else np.searchsorted(sizes, -(-n[left] * like.similar // PARTS))
    for i, a, b in zip(left.tolist(), least.tolist(), most.tolist()):
        j = right[a:b]
        if len(j):
            j = j[(root[j] != root[i]) & like.overlap_fits(1 + np.minimum(rest[i], rest[j]), n[i] + n[j])]
            if len(j):
                yield i, j


PLACED = ("gram", "cls", "root", "n", "pos")


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(PLACED))], PLACED)


def _live(batches: Iterator[pa.RecordBatch], like: Likeness, suffix: bool) -> Iterator[pa.RecordBatch]:
    """The rows that have any partner under the length and positional filters, and the suffix filter if asked."""
    found: list[tuple] = []
    for (gram, one, two), rows in _grouped(batches, ("side", "root", "n", "pos", "cls", *(["ranges"] if suffix else []))):
        counts = _Counts([r[5] for r in rows]) if suffix else None
        sizes = np.array([r[2] for r in rows])
        alive: set[int] = set()
        for i, j in _feasible(rows, one == two, like):
            if counts is not None:
                j = j[like.ranges_fit(counts.apart(np.full(len(j), i), j), sizes[j] + sizes[i])]
            if len(j):
                alive.add(i)
                alive.update(j.tolist())
        found += [(gram, rows[i][4], *rows[i][1:4]) for i in alive]
        if len(found) > 50_000:
            yield _placed(found)
            found = []
    yield _placed(found)


def _meet(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Pairs of classes, told at the first shingle that their prefixes share, after the suffix filter.

    What follows that shingle bounds the overlap, so a pair that fails there is no pair anywhere.
    """
    a, b = [], []
    for (gram, one, two), rows in _grouped(batches, ("side", "root", "n", "pos", "cls", "own", "ranges")):
        owns = [dict.fromkeys(r[5]) for r in rows]
        counts = _Counts([r[6] for r in rows])
        for i, j in _feasible(rows, one == two, like):
            apart = counts.apart(np.full(len(j), i), j)
            sizes = np.array([rows[k][2] for k in j.tolist()]) + rows[i][2]
            for k in j[like.ranges_fit(apart, sizes)].tolist():
                if next((g for g in owns[i] if g in owns[k]), gram) == gram:
                    a.append(min(rows[i][4], rows[k][4]))
                    b.append(max(rows[i][4], rows[k][4]))
        if len(a) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _near(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """For each class of a shingle (cls, apart, other): of the classes it may link with, the one whose counts by
    range differ least, but for those with which it is known not to link."""
    found: tuple[list, list, list] = [], [], []
    for (_, one, two), rows in _grouped(batches, ("side", "root", "n", "pos", "cls", "ranges", "failed")):
        counts = _Counts([r[5] for r in rows])
        sizes = np.array([r[2] for r in rows])
        at = {r[4]: k for k, r in enumerate(rows)}
        failed: dict[int, set[int]] = {}
        for k, r in enumerate(rows):
            for other in r[6] or ():
                if other in at:
                    failed.setdefault(k, set()).add(at[other])
                    failed.setdefault(at[other], set()).add(k)
        least, other = np.full(len(rows), 1 << 31), np.full(len(rows), -1)
        for i, j in _feasible(rows, one == two, like):
            if i in failed:
                j = j[~np.isin(j, [*failed[i]])]
            apart = counts.apart(np.full(len(j), i), j)
            fits = like.ranges_fit(apart, sizes[j] + sizes[i])
            j, apart = j[fits], apart[fits]
            for k, to, d in ((j, i, apart), (i, j[apart.argmin()], apart.min())) if len(j) else ():
                nearer = d < least[k]
                least[k], other[k] = np.where(nearer, d, least[k]), np.where(nearer, to, other[k])
        for i in np.flatnonzero(other >= 0).tolist():
            for column, value in zip(found, (rows[i][4], int(least[i]), rows[other[i]][4])):
                column.append(value)
        if len(found[0]) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["cls", "apart", "other"])
            found = [], [], []
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["cls", "apart", "other"])


def _dealt(rows: DataFrame, about: DataFrame | None = None, cold: DataFrame | None = None) -> DataFrame:
    """Rows of grams with several components, each gram's together and in order of size; grams with more than BLOCK
    rows as pairs of blocks.

    Grams of `rows` may have any number of rows: they are summed before the shuffle and join the sums. Those of `cold`
    are not hot: they are shuffled once and see their gram's others there. What is known `about` each cls joins last,
    so that these wide columns are shuffled with the rows once only.

    Of each gram the largest component stands apart: its rows only meet those of other components, so
    that a group that is connected but for a few is compared with these few only.
    """
    by_root = rows.groupBy("gram", "root").agg(F.count("*").alias("k"))
    sizes = by_root.groupBy("gram").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("rows"))
    rows = rows.join(sizes.where("rows > m.k"), "gram")
    if cold is not None:
        same = Window.partitionBy("gram")
        cold = cold.repartition("gram").withColumn("k", F.count("*").over(Window.partitionBy("gram", "root")))
        cold = cold.withColumn("m", F.max(F.struct("k", "root")).over(same)).withColumn("rows", F.count("*").over(same)).drop("k")
        rows = rows.unionByName(cold.where("rows > m.k"))
    rows = rows.withColumns({"apart": F.col("root") == F.col("m.root"), "others": F.col("rows") - F.col("m.k"), "few": F.ceil((F.col("rows") - F.col("m.k")) / BLOCK), "many": F.ceil(F.col("m.k") / BLOCK)})
    hashed = F.xxhash64("cls", "gram")
    rows = rows.withColumn("mine", F.when(F.col("apart"), F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))))
    alone = ~F.col("apart") & (F.col("others") == 1)  # no other of its block to meet
    to = F.sequence(F.when(alone, 1).otherwise(0).cast("long"), F.when(F.col("apart"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    deal = F.transform(to, lambda x: F.struct(F.least(x, F.col("mine")).alias("one"), F.greatest(x, F.col("mine")).alias("two"), F.when(x < F.col("mine"), 1).otherwise(0).alias("side")))
    rows = rows.withColumn("d", F.explode(deal)).select("*", "d.one", "d.two", "d.side").drop("d", "mine", "m", "rows", "others", "few", "many", "apart")
    if about is not None:
        rows = rows.join(about, "cls")
    return rows.repartition(spread(rows.sparkSession), "gram", "one", "two").sortWithinPartitions("gram", "one", "two", "n")


def _remaining_pairs(rest: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a shingle of `rest` and pass the filters, once each.

    Rows carry what the suffix filter and the choice of a pair's first shingle need.
    """
    own = rest.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gram"))), lambda x: x["gram"]).alias("own"))
    about = own.join(classes.select("cls", "ranges"), "cls")
    return _dealt(rest, about).mapInArrow(lambda batches: _meet(batches, like), "a long, b long")


def _side(df: DataFrame, name: str, **columns: str) -> DataFrame:
    return df.select(F.col("cls").alias(name), *(F.col(c).alias(alias) for alias, c in columns.items()))


class _Join:
    """One run of the join: its classes, tables and pairs verified so far."""

    def __init__(self, docs: DataFrame, like: Likeness, bits: int):
        self.spark, self.like, self.bits = docs.sparkSession, like, bits
        self.shelf = Shelf(self.spark, "ngrams")
        key = F.col("doc_id").cast("long")
        digest = F.xxhash64(F.col("text"))
        self.docs = docs.select(key.alias("doc_id"), digest.alias("digest"), F.coalesce(key, digest).alias("place"), "text")
        self.clash: DataFrame | None = None
        self.classes: DataFrame | None = None
        self.sets: DataFrame | None = None

    def known(self) -> DataFrame:
        """All documents with their classes' names; the classes."""
        counts = frequency_table(self.docs, self.like)
        table = self.spark.sparkContext.broadcast((counts, hot_from(counts)))
        known = self.shelf.put(self.docs.mapInArrow(_prefixes(table, self.like, self.bits), KNOWN), "known")
        self.classes = self._classes(known, "classes")
        clash = self.classes.where("least <> most")
        if not clash.isEmpty():
            self.clash = clash.select("cls", "least")
            known = _apart(known, self.clash)
            self.classes = self._classes(known, "named")
        return known

    def _classes(self, known: DataFrame, name: str) -> DataFrame:
        rows = known.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min("place").alias("place"), F.first("n").alias("n"), F.first("ranges").alias("ranges"), F.min("more").alias("least"), F.max("more").alias("most"))
        return self.shelf.put(rows, name)

    def fetch(self, wanted: DataFrame, name: str) -> None:
        """Whole sets of the classes wanted, from one scan of the texts; Spark broadcasts their places if these are few."""
        places = self.shelf.put(wanted.select("cls").distinct().join(self.classes, "cls").select("place").distinct(), f"{name}-places")
        sets = self.docs.join(places, "place", "left_semi").select("text").mapInArrow(_sets(self.like, self.bits), "cls long, more long, members binary")
        self.sets = self.shelf.put(_apart(sets, self.clash).select("cls", "members"), f"{name}-sets")

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes that pass the length and suffix filters."""
        long_enough = self.like.sizes_fit(F.least("na", "nb"), F.greatest("na", "nb"))
        narrow = pairs.join(_side(self.classes, "a", na="n", ra="ranges"), "a").join(_side(self.classes, "b", nb="n", rb="ranges"), "b").where(long_enough)
        like = self.like
        return narrow.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lambda batches: _suffix_ok(batches, like), "a long, b long")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of the pairs (a, b) of classes, whose sets were fetched, those that link, by both whole sets."""
        wanted = self.shelf.put(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), f"{name}-wanted")
        one = self.sets.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("members").alias("members"))
        whole = pairs.join(_side(one, "a", sa="members"), "a").join(_side(one, "b", sb="members"), "b")
        like = self.like
        return self.shelf.put(whole.select("a", "b", "sa", "sb").mapInArrow(lambda batches: _linked(batches, like), "a long, b long"), f"{name}-links")

    def with_partner(self, rest: DataFrame, suffix: bool = False, cold: DataFrame | None = None) -> DataFrame:
        """Rows of `rest` (and `cold`, see _dealt) with a partner under the length and positional filters, and the
        suffix filter if asked.

        Components only grow, so what has no partner in another one now has none later either.
        """
        like = self.like
        dealt = _dealt(rest, self.classes.select("cls", "ranges") if suffix else None, cold)
        return dealt.mapInArrow(lambda batches: _live(batches, like, suffix), ", ".join(f"{c} long" for c in PLACED)).distinct()

    def alike(self, rest: DataFrame, name: str) -> DataFrame:
        """Rows of `rest` with a partner under the suffix filter, too.

        A shingle of two rows stands for one pair. Two long sets share many of these: each pair is filtered once and
        keeps the first of its shingles only, which is all that the positional filter and later steps need. Counts by
        range, of which long sets have many, so travel once for a pair, not once for each shingle that it shares.
        """
        at = F.struct("cls", "pos")
        two = rest.groupBy("gram").agg(F.count("*").alias("rows"), F.min(at).alias("x"), F.max(at).alias("y")).where("rows = 2")
        two = self.shelf.put(two.select("gram", F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.pos").alias("pos")), f"{name}-two")
        first = self.shelf.put(two.groupBy("a", "b").agg(F.min(F.struct("pos", "gram")).alias("m")).select("a", "b", F.col("m.gram").alias("gram")), f"{name}-first")
        fit = first.join(self.filtered(first.select("a", "b")), ["a", "b"], "left_semi").select("gram")
        more = self.with_partner(rest.join(two.select("gram"), "gram", "left_anti"), True)
        found = self.shelf.put(rest.join(fit, "gram", "left_semi").select(*PLACED).unionByName(more), f"{name}-alike")
        self.shelf.drop(f"{name}-two", f"{name}-first")
        return found

    def unconnected(self, grams: DataFrame, root: DataFrame, name: str) -> DataFrame:
        """Rows (gram, cls, n, pos) of the shingles whose classes stand in more than one component, with their component.

        Where grams tell which shingles are `hot`, only rows of these are put down and summed.
        """
        placed = grams.drop("root").join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        cold = None
        if "hot" in grams.columns:
            placed, cold = (placed.where(which).select(*PLACED) for which in ("hot", "NOT hot"))
        return self.shelf.put(self.with_partner(self.shelf.put(placed, name), cold=cold), f"{name}-live")

    def nearest(self, rest: DataFrame, classes: DataFrame, failed: DataFrame, name: str) -> DataFrame:
        """(cls, other): each class of `rest`, of which `classes` has all, with the nearest of another component that it isn't known not to link with.

        failed (cls, other) holds for a class the heads of its own prefix and its nearest of earlier
        rounds, no more than its prefix and ROUNDS rows.
        """
        like = self.like
        about = classes.select("cls", "ranges").join(failed.groupBy("cls").agg(F.collect_list("other").alias("failed")), "cls", "left")
        near = _dealt(rest, about).mapInArrow(lambda batches: _near(batches, like), "cls long, apart long, other long")
        return self.shelf.put(near.groupBy("cls").agg(F.min(F.struct("apart", "other")).alias("m")).select("cls", F.col("m.other").alias("other")), name)


def _headed(known: DataFrame, tell_hot: bool = False) -> DataFrame:
    """Rows (gram, cls, where, head, head_n) of the shingles that several classes have in their prefix, once each;
    the head is the least, head_n its size. With `hot`, if asked.

    Rows of shingles that are not hot are shuffled once and see their shingle's others there. Rows of hot ones are
    summed before the shuffle and join the sums, so that adaptive execution can split them.
    """
    where = (F.col("n") * 4294967296 + F.col("pos")).alias("where")
    rows = known.where("cls IS NOT NULL")
    rows = [part.select("cls", "n", "cold", F.posexplode("prefix").alias("pos", "gram")).where(which).select("gram", "cls", where) for part, which in ((rows, "pos < cold"), (rows.where("size(prefix) > cold"), "pos >= cold"))]
    same = Window.partitionBy("gram")
    least, most = F.min(F.struct("cls", F.shiftright("where", 32).alias("n"))), F.max("cls")
    cold = rows[0].repartition("gram").withColumn("least", least.over(same)).withColumn("most", most.over(same))
    hot = rows[1].join(rows[1].groupBy("gram").agg(least.alias("least"), most.alias("most")).where("least.cls <> most"), "gram")
    names = ["gram", "cls", "where", F.col("least.cls").alias("head"), F.col("least.n").alias("head_n")]
    return reduce(DataFrame.unionByName, (part.where("least.cls <> most").select(*names, *([F.lit(heat).alias("hot")] if tell_hot else [])).distinct() for part, heat in ((cold, False), (hot, True))))


def _star(grams: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of a head and a class of its shingle that pass the length filter."""
    n, m = F.shiftright("where", 32), F.col("head_n")
    return grams.where("cls <> head").where(like.sizes_fit(F.least(n, m), F.greatest(n, m))).select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()


def _pair(df: DataFrame) -> DataFrame:
    """(cls, other) -> pairs (a, b), once each."""
    return df.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _failed(chosen: DataFrame, links: DataFrame) -> DataFrame:
    """Of (cls, other) those that don't link."""
    return chosen.withColumn("a", F.least("cls", "other")).withColumn("b", F.greatest("cls", "other")).join(links, ["a", "b"], "left_anti").select("cls", "other")


def ngram_components(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, name_bits: int = NAME_BITS) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, n_shingles, component_id, and digest (of the text), component (null if empty).

    Documents link when their sets of shingles of `words` words have a Jaccard similarity of `similar`
    hundredths at least. Components of links come out, not the links inside them.

    1. Shingle frequencies over all documents (a table of fixed size) give the rare-first order.
    2. Documents of equal sets are one class. A class is known by its prefix: the rarest shingles, of
       which a linked class must share one.
    3. Each shingle's smallest class is its head. Classes are paired with the heads of their prefix,
       and each pair is verified once: length and suffix filter, then whole sets. Groups of near
       copies are thus connected at a cost in proportion to their size.
    4. Where a shingle's classes are not in one component by then, each class is verified with the
       nearest of another component that passes the filters and wasn't verified with it before, in
       ROUNDS rounds. What belongs to a group of near copies mostly joins it here, again at a cost in
       proportion to the group's size.
    5. Shingles whose classes still are not in one component give their remaining pairs, between
       different components only and without those verified before, with length, positional and
       suffix filter and the same verification. No link between components is lost; pairs inside one
       don't matter to it and are never made.

    Whole sets are fetched by two scans of the texts, one for step 3, one for steps 4 and 5. All joins are
    by shingle, class or component key with plain sums beside them, so that adaptive execution can split
    a key with many rows. Sets are told apart by 128 bits of a digest, shingles by 64 bits of a hash;
    name_bits is lowered by tests only. Null texts, and texts without words, have no shingles and stay
    alone. Repeated rows and repeated doc_ids are answered row by row; rows without doc_id link like all
    others, and have a null component_id if no row of their component has one. An empty table gives an
    empty one. Other columns are never read.
    """
    small_batches(docs.sparkSession)
    like = Likeness(words, similar)
    run = _Join(docs, like, name_bits)
    shelf = run.shelf
    known = run.known()
    grams = shelf.put(_headed(known, True), "grams")
    answers = shelf.put(known.select("doc_id", "digest", "n", "cls"), "answers")
    shelf.drop("known")
    star = shelf.put(run.filtered(_star(grams, like)), "star")
    run.fetch(star.select(F.explode(F.array("a", "b")).alias("cls")), "star")
    links = run.verify(star, "star")
    shelf.drop("star-sets", "star-places")
    root = components(links, "ngrams-star")
    placed = grams.select("gram", "cls", F.expr("shiftright(where, 32)").alias("n"), F.expr("where & 4294967295").alias("pos"), "hot")
    rest = run.alike(run.unconnected(placed, root, "apart"), "apart")
    shelf.drop("grams", "apart", "apart-live")
    run.fetch(rest, "rest")
    classes = shelf.put(run.classes.join(rest.select("cls").distinct(), "cls", "left_semi").select("cls", "ranges"), "rest-classes")
    done, failed = star, _failed(star.select(F.col("b").alias("cls"), F.col("a").alias("other")), links)
    for k in range(ROUNDS):
        chosen = run.nearest(rest, classes, failed, f"near{k}")
        pairs = shelf.put(_pair(chosen), f"near{k}-pairs")
        links = run.verify(pairs, f"near{k}")
        done, failed = done.unionByName(pairs), failed.unionByName(_failed(chosen, links))
        root = joined_components(root, links, f"ngrams-near{k}")
        rest = run.unconnected(rest, root, f"apart{k}")
        shelf.drop(f"apart{k}")
    pairs = shelf.put(_remaining_pairs(rest, classes, like).join(done, ["a", "b"], "left_anti"), "last")
    root = joined_components(root, run.verify(pairs, "last"), "ngrams-last")
    shelf.drop("rest-sets", "rest-places")
    named = run.classes.select("cls", "low").join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(lowest, "root").select("cls", "component_id", F.col("root").alias("component"))
    return answers.join(ids, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "digest", "component")


def _bits(table: pa.Table, width: int) -> pa.Table:
    """The cells of a slice as bits."""
    bits = np.zeros(width, bool)
    bits[np.asarray(table.column("cell")) % width] = True
    return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _may_be_among(ids: DataFrame):
    """A test of hashes xxhash64(doc_id, digest): false for no row of ids, and true for few others.

    Each row sets two of 16 bits a row at least, so that of others one or two in a hundred pass, more from MOST_BITS
    on. The driver sees the table of bits only.
    """
    width, size = SLICE_BITS, min(max(1 << (16 * ids.count()).bit_length(), SLICE_BITS), MOST_BITS)
    cells = F.transform(F.array("h", F.shiftrightunsigned("h", 32)), lambda x: x.bitwiseAND(size - 1))
    cells = ids.select(F.xxhash64("doc_id", "digest").alias("h")).select(F.explode(cells).alias("cell"))
    slices = cells.withColumn("slice", F.floor(F.col("cell") / width).cast("int")).groupBy("slice").applyInArrow(lambda rows: _bits(rows, width), "slice int, bits binary")
    table = np.zeros((size // width, width // 8), np.uint8)
    for part, bits in slices.collect():  # one row for `width` bits
        table[part] = np.frombuffer(bytes(bits), np.uint8)
    table = ids.sparkSession.sparkContext.broadcast(table.reshape(-1))

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        h = np.asarray(hashes).view(np.uint64)
        found = [table.value[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1 for c in (h & np.uint64(size - 1), h >> np.uint64(32) & np.uint64(size - 1))]
        return pa.array((found[0] & found[1]).astype(bool))

    return may


def keep_one(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """docs with one row of each component; those without shingles all stay.

    The row of the smallest doc_id stays, of rows that repeat it the one of the smallest digest of the
    text, of rows that repeat that text, too, a single one. Rows without doc_id stay unless their
    component has a row with one. Columns of docs keep any name; an empty table gives an empty one.
    Whole rows are shuffled only if a table of bits lets them pass for rows that go, and joined then.
    """
    shelf = Shelf(docs.sparkSession, "ngrams-keep")
    found = shelf.put(ngram_components(docs, words, similar).where("component IS NOT NULL").select("doc_id", "digest", "component"), "found")
    best = found.where("doc_id IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("best"))
    judged = found.join(best, "component").withColumn("stays", F.coalesce(F.struct("doc_id", "digest") == F.col("best"), F.lit(False)))
    gone = shelf.put(judged.where("NOT stays").select("doc_id", "digest").distinct(), "gone")
    twice = shelf.put(judged.where("stays").groupBy("doc_id", "digest").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "twice")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))

    def only(ids: DataFrame, how: str) -> DataFrame:
        may = _may_be_among(ids)(F.xxhash64("id", "key"))
        met = rows.where(may).join(ids, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("digest")), how)
        return met if how == "left_semi" else rows.where(~may).unionByName(met)

    if twice.isEmpty():
        return only(gone, "left_anti").select("row.*")
    return only(gone.unionByName(twice), "left_anti").unionByName(only(twice, "left_semi").dropDuplicates(["id", "key"])).select("row.*")
