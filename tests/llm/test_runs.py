"""Periodic runs against all pairs of places, and the query against the contract word by word."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from shelfmark.llm import queries, runs

from .test_operators import ODD, docs_of


def brute(words):
    """(start, length, period), by start, then period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(12, 2 * q):
                found.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def of(sequences, append=runs.APPEND):
    return [sorted(zip(*(x.tolist() for x in r)), key=lambda r: (r[0], r[2])) for r in runs.runs_of([np.array(x, np.int64) for x in sequences], append)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return [bin(k).count("1") % 2 for k in range(n)]


def sequences():
    rng = random.Random(3)
    out = [[], [1], [1] * 11, [1] * 12, [1] * 13, [1] * 500, fibonacci(400), thue_morse(300), [0, 1] * 90 + [0], [*range(40)] * 2, [*range(40)] * 2 + [0, 1, 2], [9, *range(6), *range(6), 8], [*range(7)] * 2, [0, 0, 0, 1] * 50]
    for _ in range(400):
        n, k = rng.randrange(1, 160), rng.choice((1, 2, 3, 20))
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            at, p = rng.randrange(n), rng.randrange(1, 30)
            x[at:at] = x[at : at + p] * rng.randrange(1, 6)
        out.append(x)
    return out


@pytest.mark.parametrize("append", [1, 5, 64, runs.APPEND])
def test_runs_are_those_of_all_pairs_of_places(append):
    some = sequences() if append > 1 else sequences()[:20]
    want = [brute(x) for x in some]
    assert of(some, append) == want
    for x, w in zip(some, want):
        assert of([x], append) == [w]


def test_each_period_has_one_size_of_catcher():
    for q in range(1, 3000):
        met = [k for k in range(14) for low, high in runs.lags(k) if low <= q <= high]
        assert len(met) == 1 and 2 ** (met[0] + 1) - 1 <= max(runs.LEAST - q, q)


def test_long_sequences_take_little_more_than_linear_time():
    for x in ([7] * 300_000, fibonacci(200_000), [*range(1000)] * 300, thue_morse(200_000)):
        began = time.process_time()
        found = of([x])[0]
        assert time.process_time() - began < 30
        assert all(x[s] == x[s + q] and x[s + n - 1] == x[s + n - 1 - q] for s, n, q in found[:50])
    assert of([[7] * 300_000])[0] == [(0, 300_000, 1)]
    assert of([[*range(1000)] * 300], 1 << 12)[0] == [(0, 300_000, 1000)]


def contract(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if plant and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a, w0 = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [w0[a + (i - a) % p] if i >= a else w0[i] for i in range(n)]
    found = brute(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    kept = [x for i, x in enumerate(w) if i not in gone]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(kept)), n, len(kept))


def test_query_against_the_contract(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert found.keys() == docs.keys()
    for doc_id, text in docs.items():
        if len((text or "").split()) < 1500:
            assert found[doc_id] == contract(doc_id, text)
    assert sum(r[1] > 0 for r in found.values()) > 10


def test_odd_rows(spark):
    rows = [*ODD, (None, "a " * 40), (8, "a b " * 9 + "é\x85 \x0b" + "c d e " * 9)]
    rows = [(i, t) for i, t in rows if len(t or "") < 5000]
    found = sorted(map(tuple, runs.periodic_runs(docs_of(spark, rows), plant=True).collect()), key=repr)
    assert found == sorted((contract(i, t) for i, t in rows), key=repr)
    assert runs.periodic_runs(docs_of(spark, []), plant=True).collect() == []


def test_texts_without_their_repeats(spark):
    rows = [(1, "go on " * 20 + "stop"), (2, "no  repeats\there"), (3, None), (None, "x " * 30000)]
    found = {r.doc_id: r.text for r in runs.without_repeats(docs_of(spark, rows)).collect()}
    assert found == {1: "go on stop", 2: "no  repeats\there", 3: None, None: "x"}
    assert runs.without_repeats(docs_of(spark, rows)).columns == docs_of(spark, rows).columns
