"""Mixing where many rows repeat or lack a doc_id, against the prefix sums taken in one piece."""

import hashlib
from collections import Counter
from math import floor

from shelfmark.llm import mixing

from .test_operators import docs_of


def test_repeated_and_missing_ids_are_split_and_taken_as_often(spark, tmp_path):
    rows = [(None, "a b")] * 300 + [(7, "c d e")] * 200 + [(k, "x " * (k % 9)) for k in range(100, 400)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    want = Counter((i, len((t or "").split())) for i, t in rows)
    for bucket_rows in (10, 100_000):
        out = mixing.mix_sources(docs, bucket_rows=bucket_rows).select("row.doc_id", "size", "copies", "taken").collect()
        # one source takes its own size: every document once
        assert Counter((r.doc_id, r.size) for r in out) == want and all(r.copies == 1 and r.taken == r.size for r in out)
    assert Counter(r.doc_id for r in mixing.emit_mix(docs, bucket_rows=10).collect()) == Counter(i for i, _ in rows)


def test_copies_are_the_crossings_of_one_prefix_sum(spark, tmp_path):
    rows = [("a", k, 1 + k * 7 % 40) for k in range(300)] + [("b", 1000 + k, 1 + k * 3 % 50) for k in range(90)] + [("c", 2000 + k % 5, 6) for k in range(60)]
    spark.createDataFrame([(k, s, "w " * n) for s, k, n in rows], "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    out = mixing.mix_sources(spark.read.parquet(f"{tmp_path}/d"), bucket_rows=20).select("row.*", "*").collect()
    for source in "abc":
        mine = [r for r in out if r.source == source]
        rate = mine[0].target / mine[0].source_size
        offset = int(hashlib.md5(f"mix:s{source}".encode()).hexdigest()[:8], 16) / 2**32
        crossed = floor(rate * len(mine) + offset)
        assert sum(r.copies for r in mine) == crossed and all(r.copies in (floor(rate), floor(rate) + 1) for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.1 * mine[0].target
    assert sum(r.size for r in out) == sum(r.source_size for r in {r.source: r for r in out}.values())


def test_one_id_with_rows_of_many_sizes_is_taken_alike_whatever_the_layout(spark, tmp_path):
    rows = [("a", None, 64 + k % 4) for k in range(400)] + [("a", 5, 64 + k % 3) for k in range(150)] + [("a", k, 40 + k % 50) for k in range(10, 200)] + [("b", k, 30) for k in range(1000, 1700)] + [("c", k, 30) for k in range(3000, 3400)]
    schema = "doc_id long, source string, text string"

    def key(r):
        return len(bin(r[2])) - 2, r[2] >> max(len(bin(r[2])) - 6, 0), hashlib.md5(("" if r[1] is None else str(r[1])).encode()).hexdigest(), r[2]

    found = []
    for parts, bucket_rows in ((3, 20), (5, 20), (4, 100_000), (2, 90)):
        at = f"{tmp_path}/{parts}-{bucket_rows}"
        spark.createDataFrame([(k, s, "w " * n) for s, k, n in rows], schema).repartition(parts).write.parquet(at)
        out = mixing.mix_sources(spark.read.parquet(at), bucket_rows=bucket_rows).select("row.source", "row.doc_id", "size", "copies", "source_size", "target").collect()
        found.append(Counter((r.source, r.doc_id, r.size, r.copies) for r in out))
        rate = {r.source: r.target / r.source_size for r in out}
    assert 1 < rate["a"] < 3 and rate["a"] % 1 > 0.05
    want = Counter()
    for source in "abc":
        offset = int(hashlib.md5(f"mix:s{source}".encode()).hexdigest()[:8], 16) / 2**32
        for rank, (s, doc_id, n) in enumerate(sorted((r for r in rows if r[0] == source), key=key), 1):
            want[s, doc_id, n, floor(rate[source] * rank + offset) - floor(rate[source] * (rank - 1) + offset)] += 1
    assert all(f == want for f in found)
