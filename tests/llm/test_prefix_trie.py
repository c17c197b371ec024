"""The trie of conversations against rebuilt turns in memory."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shelfmark.llm import prefix_trie, queries, shared

CONV = "conv_id long, turn long, role string, text string, node string, depth string, at string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONV).repartition(parts)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
        ends[ts].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()))


def test_monoid_products():
    m = prefix_trie.Monoid(4)
    turns = [m.turn("r", str(k)) for k in range(9)]

    def of(ts):
        out = 0
        for t in ts:
            out = m.product(out, t, 1)
        return out

    for k in range(10):
        assert m.product(of(turns[:k]), of(turns[k:]), 9 - k) == of(turns)
        assert m.rest(of(turns), of(turns[:k]), 9 - k) == of(turns[k:])
    assert m.turn("ab", "c") != m.turn("a", "bc")


def test_query_against_rebuilt_turns(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_prefix_trie(spark, sf)) == brute(rows)


def some_rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(95, 130), *range(250, 262), 1000, 1001, -5, -100, -101]:
        for t in rng.sample([None, *range(8)], rng.choice((0, 1, 2, 5, 8, 9))):
            rows.append((c, t, rng.choice(("user", "assistant", None)) if rng.random() < 0.2 else "user", rng.choice(("hi", "é𝒳", "", None, "x" * 50)) if rng.random() < 0.4 else "hi"))
    return rows


def test_random_conversations(spark):
    assert rows_of(prefix_trie.prefix_trie(table(spark, some_rows()))) == brute(some_rows())


def test_a_conversation_with_most_rows_spans_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    rows = [(7, t, "user", f"say {t % 11}") for t in range(900)] + [(c, t, "user", f"say {t}") for c in range(100, 160) for t in range(7)] + [(201, t, "user", f"say {t % 11}") for t in range(450)]
    df = table(spark, rows, 5)
    parts = prefix_trie.turns_of(df, 0)
    assert sorted(r.at for r in parts.where("conv_id = 7").collect()) == [*range(900)]
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(rows)


def test_odd_rows(spark):
    assert rows_of(prefix_trie.prefix_trie(table(spark, [(None, 1, "a", "b")]))) == []
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame([], CONV))) == []
    rows = [(1, 1, "a", "b")] * 3 + [(2, 1, "a", "b"), (2, 2, "a", "b"), (2, 3, "a", "b"), (3, None, None, None), (None, 1, "a", "b"), (4, 1, "a", "long " * 100_000)]
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_equal_fingerprints_of_unequal_turns_are_found(spark):
    rows = [(c, t, "user", f"{c}{t}") for c in range(100, 106) for t in range(3)]
    turns = shared.settle(prefix_trie.turns_of(table(spark, rows), 1), "t")
    plans = prefix_trie.rebuilt(prefix_trie.bases(turns))
    found = prefix_trie.members(turns, plans, 1)
    assert prefix_trie.unequal(found, turns).isEmpty()
    wrong = found.withColumn("node", F.when(F.col("depth") == 1, F.lit(b"same")).otherwise(F.col("node")))
    assert prefix_trie.unequal(wrong, turns).count() == 1
