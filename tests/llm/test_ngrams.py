"""The n-gram join where names of sets clash, ids are missing, columns have inner names, and shingles are hot."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import ngrams

from .test_operators import brute_components, docs_of


def near_copies(seed, groups=6, each=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_sets_whose_names_clash_and_rows_without_ids(spark):
    rows = near_copies(7)
    rows = [(None if i % 5 == 0 else i, t) for i, t in rows] + [(None, "only this one has no id at all"), (None, "Only this one has no id at all"), (900, None), (None, "")]
    want = brute_components(rows)
    for bits in (3, 64):
        found = ngrams.ngram_components(docs_of(spark, rows), name_bits=bits).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, found)) == want


def test_one_row_of_each_component_stays_whatever_columns_are_called(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "A b c d e f g"), (5, "quite other words stand in here"), (None, "a b c d e f g"), (None, "alone without any id here"), (None, "alone without any id here"), (8, None), (8, None), (9, "")]
    docs = docs_of(spark, rows).withColumnsRenamed({"size": "id", "row": "key"}).withColumns({"_keep": F.lit(1), "digest": F.lit("d"), "component": F.lit(None).cast("string"), "a.b": F.lit(2)})
    kept = ngrams.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(5, "a b c d e f g"), (5, "quite other words stand in here"), (None, "alone without any id here"), (None, "alone without any id here"), (8, None), (8, None), (9, "")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


def test_rows_that_a_class_may_link_with():
    like, rng = ngrams.Likeness(), random.Random(8)
    for same in (True, False):
        rows = sorted(((rng.randint(0, 1), rng.randint(0, 5), rng.randint(20, 60), rng.randint(0, 12)) for _ in range(80)), key=lambda r: r[2])
        fits = lambda a, b: a[1] != b[1] and like.sizes_fit(min(a[2], b[2]), max(a[2], b[2])) and like.overlap_fits(1 + min(a[2] - a[3] - 1, b[2] - b[3] - 1), a[2] + b[2])  # noqa: E731, B023
        want = {(i, j) for i in range(80) for j in range(80) if (i < j if same else (rows[i][0], rows[j][0]) == (0, 1)) and fits(rows[i], rows[j])}
        assert {(i, k) for i, j in ngrams._feasible(rows, same, like) for k in j.tolist()} == want


def test_blocks_of_a_hot_shingle_meet_each_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    rng = random.Random(9)
    rows = [(1, k, rng.choice([0, 0, 0, 0, 1, 2, 3])) for k in range(60)] + [(2, 100 + k, k % 2) for k in range(3)]
    dealt = ngrams._dealt(spark.createDataFrame([(g, c, 30, 0, r) for g, c, r in rows], "gram long, cls long, n long, pos long, root long")).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.gram, r.one, r.two), []).append((r.side, r.cls, r.root))
    met = Counter()
    for (gram, one, two), members in groups.items():
        assert len(members) <= 30
        for k, (s, c, q) in enumerate(members):
            for t, d, p in members[k + 1 :]:
                if q != p and (one == two or s != t):
                    met[gram, min(c, d), max(c, d)] += 1
    want = {(g, min(c, d), max(c, d)) for g, c, q in rows for h, d, p in rows if g == h and c != d and q != p}
    assert set(met) == want and max(met.values()) == 1


def test_failed_pairs_are_not_verified_again(spark, monkeypatch):
    seen = Counter()
    verify = ngrams._Join.verify

    def count(self, pairs, name):
        seen.update(map(tuple, pairs.collect()))
        return verify(self, pairs, name)

    monkeypatch.setattr(ngrams._Join, "verify", count)
    rows = near_copies(10, groups=2, each=40, words=90)
    found = ngrams.ngram_components(docs_of(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_components(rows)
    assert len(seen) > 40 and max(seen.values()) == 1


def test_whole_hashes_are_compared():
    a = np.arange(1000, dtype=np.uint64) << np.uint64(3)
    assert ngrams.set_names(a) != ngrams.set_names(a + np.uint64(1)) and ngrams.set_names(a)[0] >> 60 == ngrams.set_names(a, 4)[0]


def test_the_suffix_filter_never_exceeds_the_true_difference():
    rng = np.random.default_rng(17)
    base = np.unique(rng.integers(0, 1 << 64, 9000, dtype=np.uint64, endpoint=False))
    sets = [base[:k] if k < 1000 else np.sort(rng.permutation(base)[:k]) for k in (1, 5, 400, 700, 1100, 2000, 4000, 5000, 9000)]
    sets.append(np.arange(2000, dtype=np.uint64))  # all in one range
    counts = ngrams._Counts([ngrams._ranges(np.sort(x)) for x in sets])
    assert counts.width[-1] == 0 and counts.width[0] == ngrams.RANGES < counts.width[5] < counts.width[8]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    i, j = np.array(pairs).T
    true = [len(np.setxor1d(sets[a], sets[b])) for a, b in pairs]
    apart = counts.apart(i, j)
    assert (apart <= true).all() and all(apart[k] == 0 for k, (a, b) in enumerate(pairs) if a == b)
    fresh = ngrams._Counts([ngrams._ranges(np.sort(rng.integers(0, 1 << 64, 8000, dtype=np.uint64))) for _ in range(2)])
    assert not ngrams.Likeness().ranges_fit(fresh.apart(np.array([0]), np.array([1]))[0], 16000)


def test_counts_by_range_are_whole_however_they_are_packed():
    rng = np.random.default_rng(5)
    few = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64, endpoint=False))
    hot = np.arange(200, dtype=np.uint64)  # more than two in a byte can hold
    for found in (few[:1], few, hot, np.unique(np.concatenate((few, hot)))):
        packed = ngrams._ranges(found)
        assert np.frombuffer(ngrams._each(packed), np.uint8).tolist() == np.bincount(found >> np.uint64(57), minlength=128).tolist()
    assert len(ngrams._ranges(few)) == 65 and len(ngrams._ranges(hot)) == 128


def test_a_pair_keeps_the_first_of_the_shingles_that_are_its_alone(spark):
    rng = np.random.default_rng(6)
    one, far = (np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64, endpoint=False)) for _ in range(2))
    sets = {1: one, 2: one[:-10], 3: far, 4: one[10:]}
    run = ngrams._Join(docs_of(spark, []), ngrams.Likeness(), ngrams.NAME_BITS)
    run.classes = spark.createDataFrame([(c, len(x), bytearray(ngrams._ranges(x))) for c, x in sets.items()], "cls long, n long, ranges binary")
    met = [(10, (1, 2), 0), (11, (1, 2), 3), (12, (1, 3), 1), (13, (1, 2, 4), 5), (14, (3, 4), 2), (15, (2, 3, 4), 6)]
    rest = spark.createDataFrame([(g, c, c, len(sets[c]), pos) for g, classes, pos in met for c in classes], "gram long, cls long, root long, n long, pos long")
    found = {(r.gram, r.cls) for r in run.alike(rest, "test").collect()}
    assert found == {(10, 1), (10, 2), (13, 1), (13, 2), (13, 4), (15, 2), (15, 4)}


def test_hot_and_other_shingles_have_the_same_heads(spark, monkeypatch):
    rows = near_copies(12, groups=4, each=20)
    docs, found, cold = docs_of(spark, rows), [], []
    for hot in (0, 12, 1 << 12):
        monkeypatch.setattr(ngrams, "HOT", hot)
        monkeypatch.setattr(ngrams, "HOT_MEANS", 0)
        known = ngrams._Join(docs, ngrams.Likeness(), ngrams.NAME_BITS).known()
        found.append(Counter(map(tuple, ngrams._headed(known).collect())))
        cold.append(known.agg(F.sum("cold"), F.sum(F.size("prefix"))).first())
        if hot == 12:
            shared = known.select("cls", "cold", F.posexplode("prefix").alias("pos", "gram")).where("pos < cold").groupBy("gram").count()
            assert shared.agg(F.max("count")).first()[0] <= hot
            assert Counter(map(tuple, ngrams.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)
    assert found[0] == found[1] == found[2] and found[0]
    assert cold[0][0] == 0 < cold[1][0] < cold[1][1] and cold[2][0] == cold[2][1]


def shuffled(plan):
    """Rows that the exchanges of an executed plan wrote."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if "QueryStage" in name:
        return shuffled(plan.plan())
    children = plan.children()
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


def test_rows_that_surely_stay_are_not_shuffled(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(8))) for i in range(1000)]
    copies = [(2000 + i, rows[i][1]) for i in range(10)] + [(7, rows[7][1])] * 2 + [(None, rows[3][1])]
    docs_of(spark, rows + copies).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (ngrams.MOST_BITS, 64):
            monkeypatch.setattr(ngrams, "SLICE_BITS", 32)
            monkeypatch.setattr(ngrams, "MOST_BITS", most)
            kept = ngrams.keep_one(docs)
            assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows)
            if most > 64:  # rows that go, rows that stand twice, some that the bits take for these, and both tables of ids
                assert shuffled(kept._jdf.queryExecution().executedPlan()) < 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_shingles_that_are_not_hot_are_dealt_as_others_are(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    rng = random.Random(13)
    rows = [(1, k, rng.choice([0, 0, 0, 1, 2])) for k in range(40)] + [(2, 100, 1), (2, 101, 2), (3, 200, 5), (3, 201, 5)]
    rows = spark.createDataFrame([(g, c, 30, 0, r) for g, c, r in rows], "gram long, cls long, n long, pos long, root long")
    tell = lambda dealt: Counter((r.gram, r.one, r.two, r.side, r.cls, r.root) for r in dealt.collect())
    summed, once = tell(ngrams._dealt(rows)), tell(ngrams._dealt(rows.limit(0), cold=rows))
    assert summed == once and max(once.values()) == 1
    assert sum(r[0] == 2 for r in once) == 2  # no row is sent where it meets none
    assert not any(r[0] == 3 for r in once)  # a single component has no pairs to find


def test_classes_of_a_shingle_stand_once_and_meet_heads_of_like_size(spark, monkeypatch):
    rows = near_copies(14, groups=3, each=15)
    rows += [(50 + i, " ".join(t.split()[:40])) for i, t in rows]
    docs = docs_of(spark, rows + [(100 + i, t) for i, t in rows]).repartition(6)
    like = ngrams.Likeness()
    for hot in (0, 1 << 12):
        monkeypatch.setattr(ngrams, "HOT", hot)
        monkeypatch.setattr(ngrams, "HOT_MEANS", 0)
        headed = ngrams._headed(ngrams._Join(docs, like, ngrams.NAME_BITS).known(), True)
        found = headed.collect()
        assert len({(r.gram, r.cls) for r in found}) == len(found) and {r.hot for r in found} == {not hot}
        want = set()
        for r in found:
            n = r["where"] >> 32
            if r.cls == r.head:
                assert n == r.head_n
            elif like.sizes_fit(min(n, r.head_n), max(n, r.head_n)):
                want.add((r.head, r.cls))
        assert {(r.a, r.b) for r in ngrams._star(headed, like).collect()} == want and want
        assert len(want) < len({(r.head, r.cls) for r in found if r.cls != r.head})
