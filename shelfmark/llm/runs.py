"""Operator 12: periodic runs of words, by catchers of squares over completed power-of-two blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mix, pieces, small_batches

#: Least words of a run, whatever its period.
LEAST = 12
#: Words that are appended together.
APPEND = 1 << 16
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
NONE = np.zeros(0, np.int64)


def lags(level: int) -> list[tuple[int, int]]:
    """Periods (from, to) whose runs a catcher of 2 ** level words meets.

    In a run of period q at least max(LEAST - q, q) words in a row equal the word q further on. Where these
    are 2 ** (level + 1) - 1 or more, they hold a whole block of 2 ** level words that begins at a multiple of
    its size. With LEAST = 12: blocks of 2 for q = 6, of 4 for 1 to 5 and 7 to 14, of 8 for 15 to 30, and so on.
    """
    out = []
    for q in range(1, LEAST):
        if (LEAST - min(q, LEAST - q) + 1).bit_length() - 2 == level:
            out = [*out[:-1], (out[-1][0], q)] if out and out[-1][1] == q - 1 else [*out, (q, q)]
    low, high = max(LEAST, 2 * 2**level - 1), 4 * 2**level - 2
    return [*out, (low, high)] if low <= high else out


class Level:
    """Catchers of one block size, and the stretches that their squares make up.

    A stretch (q, first, last) says that all blocks from `first` to `last` equal the words q further on.
    Open ones may still grow with the words to come; closed ones are whole.
    """

    def __init__(self, level: int):
        self.size, self.lags = 2**level, lags(level)
        self.hashes = np.zeros(0, np.uint64)  # of the last windows of this size, the input of the next level
        self.caught = np.zeros(0, np.uint64)  # of all completed blocks
        self.open = (NONE, NONE, NONE)
        self.closed: list[tuple[np.ndarray, ...]] = []


class Catchers:
    """Runs of a sequence of integers to which words are appended.

    Every completed block of 2 ** k words is a catcher. Each appended word ends a window of every size; its
    hash is compared with those of the catchers as far back as the size's periods reach (about two of them).
    An equal one is a square, or nearly: it is compared word by word when it has been merged with the squares
    of the same period beside it, and extended to both sides. Squares that lie within a known run whose period
    divides theirs tell nothing new. Memory is a few numbers for each word.
    """

    def __init__(self, longest: int | None = None):
        """longest: the most words that a run can have, where the sequence is known to be of parts that share none."""
        self.words, self.longest = np.zeros(0, np.int64), longest
        self.n = 0
        self.levels = [Level(0)]

    def append(self, words: np.ndarray) -> None:
        old = self.n
        self.n += len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:old], np.empty(max(self.n, 2 * old) - old, np.int64)])
        self.words[old : self.n] = words
        known = (NONE, NONE, NONE)
        for k in range(min(self.n, self.n if self.longest is None else self.longest).bit_length()):
            if k == len(self.levels):
                self.levels.append(Level(k))
            level = self.levels[k]
            new = self._windows(k, old)
            if level.lags:
                known = self._catch(level, new, known)

    def _windows(self, k: int, old: int) -> np.ndarray:
        """Hashes of all windows of 2 ** k words that end at words appended now, each from two of the level below,
        which keeps as many as that takes; whole blocks among them become catchers."""
        level, size = self.levels[k], 2**k
        first = max(0, old - size + 1)
        if k == 0:
            new = mix(self.words[old : self.n].astype(np.uint64) + np.uint64(1))
        else:
            half, below = size // 2, self.levels[k - 1].hashes
            below = below[len(below) - (self.n - half + 1 - first) :]
            new = mix(below[:-half] * np.uint64(0x9E3779B97F4A7C15) + below[half:])
        level.hashes = np.concatenate([level.hashes[max(0, len(level.hashes) - 2 * size) :], new])
        level.caught = np.concatenate([level.caught, new[-first % size :: size]])
        return new

    def _catch(self, level: Level, new: np.ndarray, known):
        """Compare the new windows with the catchers; returns `known` with this level's runs as far as they go."""
        size, first = level.size, self.n - level.size + 1 - len(new)
        found_q, found_b = [NONE], [NONE]
        for low, high in level.lags:
            begin, end = max(0, -((high - first) // size)), (self.n - size - low) // size + 1
            if begin >= end:
                continue
            # Row by row the windows that lie low to high words behind a catcher; what was compared before is left zero.
            base, width = begin * size + low, high - low + 1
            row = np.zeros((end - begin - 1) * size + width, np.uint64)
            part = new[max(0, base - first) :][: len(row) - max(0, first - base)]
            row[max(0, first - base) :][: len(part)] = part
            table = np.lib.stride_tricks.as_strided(row, (end - begin, width), (8 * size, 8))
            at, lag = np.nonzero(table == level.caught[begin:end, None])
            found_q.append(lag + low)
            found_b.append((at + begin) * size)
        q, b = np.concatenate(found_q), np.concatenate(found_b)
        if len(q):
            fresh = ~_inside(known, q, b, b + q + size)
            q, b = q[fresh], b[fresh]
        q, first, last = _merge(size, *(np.concatenate([x, y]) for x, y in zip(level.open, (q, b, b))))
        if not len(q):
            level.open = (NONE, NONE, NONE)
            return known
        grows = last + 2 * size + q > self.n
        level.open = q[grows], first[grows], last[grows]
        whole = self._extend(size, q[~grows], first[~grows], last[~grows])
        level.closed.append(whole)
        so_far = self._extend(size, *level.open)
        return tuple(np.concatenate([x, y, z]) for x, y, z in zip(known, whole, so_far))

    def _extend(self, size: int, q: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(period, start, end) of the stretches with the words beside them that belong to them. That is fewer than
        `size` on each side; one with more has squares that were left out as part of a known run, and so is that run."""
        if not len(q):
            return NONE, NONE, NONE
        x, out_q, out_s, out_e = self.words, [], [], []
        for k in range(0, len(q), max(1, APPEND // size)):
            qs, lo, hi = (a[k : k + max(1, APPEND // size)] for a in (q, first, last + size))
            steps = np.arange(1, size + 1)
            at = lo[:, None] - steps
            left = _reach((at >= 0) & (x[np.maximum(at, 0)] == x[np.maximum(at, 0) + qs[:, None]]))
            steps = np.arange(size)
            at = hi[:, None] + steps
            there = at + qs[:, None] < self.n
            right = _reach(there & (x[np.where(there, at, 0)] == x[np.where(there, at + qs[:, None], 0)]))
            own = (left < size) & (right < size)
            out_q.append(qs[own])
            out_s.append((lo - left)[own])
            out_e.append((hi + right + qs)[own])
        return tuple(np.concatenate(a) for a in (out_q, out_s, out_e))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all runs of the words so far, by start, then period."""
        parts = [c for level in self.levels for c in level.closed] + [self._extend(level.size, *level.open) for level in self.levels]
        q, s, e = (np.concatenate([p[k] for p in parts] or [NONE]) for k in range(3))
        fits = (e - s >= LEAST) & (e - s >= 2 * q)
        q, s, e = q[fits], s[fits], e[fits]
        sure = np.array([bool((self.words[a : b - p] == self.words[a + p : b]).all()) for p, a, b in zip(q.tolist(), s.tolist(), e.tolist())], bool)
        q, s, e = q[sure], s[sure], e[sure]
        # A stretch of a period that the smallest one divides is the same stretch.
        order = np.lexsort((q, e, s))
        q, s, e = q[order], s[order], e[order]
        least = np.ones(len(q), bool)
        least[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        q, s, e = q[least], s[least], e[least]
        order = np.lexsort((q, s))
        return s[order], (e - s)[order], q[order]


def _reach(same: np.ndarray) -> np.ndarray:
    """In each row, how many are true before the first that isn't."""
    ends = same.argmin(axis=1)
    return np.where(same.all(axis=1), same.shape[1], ends)


def _merge(size: int, q: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one period whose blocks follow each other become one."""
    order = np.lexsort((first, q))
    q, first, last = q[order], first[order], last[order]
    begin = np.ones(len(q), bool)
    begin[1:] = (q[1:] != q[:-1]) | (first[1:] > last[:-1] + size)
    at = np.flatnonzero(begin)
    return q[at], first[at], np.maximum.reduceat(last, at) if len(at) else last


def _inside(known, q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the stretches lie within the known one that begins before them and goes furthest, if its period divides theirs."""
    period, s, e = known
    if not len(s):
        return np.zeros(len(q), bool)
    order = np.lexsort((-period, e, s))
    period, s, e = period[order], s[order], e[order]
    furthest = np.maximum.accumulate(e)
    best = np.maximum.accumulate(np.where(e == furthest, np.arange(len(e)), 0))
    at = np.searchsorted(s, start, "right") - 1
    of = best[np.maximum(at, 0)]
    return (at >= 0) & (e[of] >= end) & (q % period[of] == 0)


def runs_of(sequences: list[np.ndarray], append: int = APPEND) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of the runs of each sequence of numbers from 0, by start, then period.

    They are caught together, a number of its own behind each, which no run can hold.
    """
    sizes = np.array([len(x) + 1 for x in sequences], np.int64)
    if not len(sizes) or sizes.max() <= LEAST:
        return [(NONE, NONE, NONE)] * len(sequences)
    joined = np.concatenate([part for k, x in enumerate(sequences) for part in (x, [-1 - k])]).astype(np.int64)
    catchers = Catchers(int(sizes.max()))
    for at in range(0, len(joined), append):
        catchers.append(joined[at : at + append])
    start, length, period = catchers.runs()
    begins = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(start, begins[1:])
    return [(s - b, n, q) for b, s, n, q in zip(begins, np.split(start, cuts), np.split(length, cuts), np.split(period, cuts))]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as op12's contract takes them: with part of some documents repeated."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def describe(texts: list[list[bytes]]) -> list[tuple]:
    """For each text's words: number of runs, start, length, period and exponent_milli of the greatest, sha256 of
    all runs and of the words that stay, number of words and of those that stay."""
    names = defaultdict(count().__next__)
    found = runs_of([np.fromiter(map(names.__getitem__, words), np.int64, len(words)) for words in texts])
    out = []
    for words, (start, length, period) in zip(texts, found):
        n, best = len(words), (None,) * 4
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in zip(start.tolist(), length.tolist(), period.tolist()))
        if len(start):
            k = np.lexsort((period, start, -length))[0]
            best = int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k])
            words = [w for w, stays in zip(words, kept_words(n, start, length, period).tolist()) if stays]
        out.append((len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), n, len(words)))
    return out


def _describe(plant: bool):
    kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [column.split()[0] for column in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            if plant:
                texts = [planted(words, d) for words, d in zip(texts, batch.column("doc_id").to_pylist())]
            rows = zip(*describe(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(rows, kinds))], names=names)

    return run


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """docs (doc_id, text, any more) -> the runs of each text's words (see SCHEMA).

    Words are what white space of ASCII parts. A run is a stretch with smallest period q and at least
    max(LEAST, 2q) words that no word beside it extends. `plant` takes the words as op12's contract changes
    them by doc_id. Null and empty texts, and those of fewer than LEAST words, have no runs and null figures;
    a null doc_id changes nothing and stays null; equal rows give equal rows; columns of any other name are
    never read; an empty table gives an empty one. A plain map over the scan: texts of about half a MB are
    done together, a longer one alone, which takes about twenty times its size for the time being.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_describe(plant), SCHEMA)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of runs behind their first periods taken out of the texts; texts without runs stay as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            words = [(t or "").encode().split() for t in texts]
            names = defaultdict(count().__next__)
            found = runs_of([np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in words])
            kept = [b" ".join(x for x, stays in zip(w, kept_words(len(w), *r).tolist()) if stays).decode() if len(r[0]) else t for t, w, r in zip(texts, words, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
