"""Operator 10: mixing sources to target weights, by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows that a bucket may hold on average before buckets are split by another hexadecimal digit.
BUCKET_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also target: the whole size shared by weight, at most `most` times a source's size.

    Weights go round by the sources' order (code points, null last). The level is found in closed
    form: ordered by cap / weight, the capped sources are a prefix. One row for each source meets in
    one task, documents never do.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("k", F.row_number().over(by_ratio)).withColumn("level", level)
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))
    rows = rows.withColumn("first", F.min(free).over(all_rows))
    return rows.select("source", "source_size", F.when(F.col("k") < F.col("first.k"), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def _digits(rows: int, most: int) -> int:
    """Hexadecimal digits that split so many rows into buckets of no more than `most`."""
    digits = 0
    while rows > most:
        digits, rows = digits + 1, rows / 16
    return digits


def mix_sources(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, source, text or `size`, any more) -> docs' columns in `row`, and size, source_size, target, copies, taken.

    Each document is expected target / source_size times. Within a source the documents stand in an
    order (size class, then a hash of doc_id), expected copies are summed along it, one offset per
    source is added, and a document is emitted once for each integer that its interval crosses. As
    expected copies are equal within a source, the prefix sum is the rate times the rank. The rank
    comes from bucket counts (source, size class, leading digits of the hash), summed over the few
    buckets, and the row number within a bucket: no source is ever sorted in one task. More digits
    split the buckets of larger inputs; the rows of a doc_id that fills a bucket are split by size, and
    those that agree in doc_id and size, which are interchangeable, by any digits. The order, and so the
    result, stays the same, whatever the buckets and the partitions of docs.

    Null texts and texts without words have size 0; their `taken` is 0. Null sources are one source.
    Null doc_ids hash as ''. Rows that agree in doc_id, source and size are interchangeable. An empty
    table gives an empty result. Columns of docs keep any name, as they stay inside `row`.
    """
    size = n_words(F.col("text")) if size is None else size
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source"))
    digits = F.length(F.bin("_mix.size"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("source"), name.alias("name"), size.cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key")).alias("_mix"))
    rows = rows.select("row", "_mix.*", F.monotonically_increasing_id().alias("nth"), (digits * 16 + F.expr("shiftright(_mix.size, greatest(length(bin(_mix.size)) - 4, 0))")).cast("int").alias("class"))

    def counted(sub: Column, rows: DataFrame) -> tuple[DataFrame, int]:
        """Sums of the buckets, and the rows of the largest."""
        found = settle(rows.groupBy("source", "name", "class", sub.alias("sub")).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-counts")
        return found, found.agg(F.max("n")).first()[0] or 0

    prefix = lambda depth: F.substring("key", 1, depth)
    depth = 2
    counts, largest = counted(prefix(depth), rows)
    if largest > bucket_rows:
        depth += _digits(largest, bucket_rows)
        counts, largest = counted(prefix(depth), rows)
    sub = prefix(depth)
    if largest > 2 * bucket_rows:  # no chance of the hash, but doc_ids with many rows
        big = counts.where(F.col("n") > 2 * bucket_rows).select("name", "class", "sub")
        keys = rows.withColumn("sub", sub).join(big, ["name", "class", "sub"], "left_semi").groupBy("name", "class", "sub", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
        hot = settle(keys.groupBy("name", "class", "sub").agg(F.sort_array(F.collect_list("key")).alias("hot")), "mix-hot")
        rows = rows.withColumn("sub", sub).join(hot, ["name", "class", "sub"], "left").drop("sub")
        # Within such a bucket: by how many of its frequent keys come before, a frequent key's rows by size, equal ones anyhow.
        frequent = F.array_contains("hot", F.col("key"))
        place = 2 * F.size(F.filter("hot", lambda k: k < F.col("key"))) + frequent.cast("int")
        any_digits = F.substring(F.md5(F.col("nth").cast("string").cast("binary")), 1, _digits(largest, bucket_rows))
        within = F.concat(F.lpad(place.cast("string"), 9, "0"), F.when(frequent, F.concat(F.lpad(F.col("size").cast("string"), 19, "0"), any_digits)).otherwise(""))
        sub = F.when(F.col("hot").isNull(), sub).otherwise(F.concat(sub, F.lit(":"), within))
        counts, largest = counted(sub, rows)
    earlier = Window.partitionBy("name").orderBy("class", "sub").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(counts.groupBy("source", "name").agg(F.sum("words").alias("source_size")).select("source", "source_size"), weights, most)
    targets = targets.withColumn("name", name).drop("source")
    start = counts.select("name", "class", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).join(targets, "name")
    rows = rows.withColumn("sub", sub).join(start, ["name", "class", "sub"])
    rank = F.col("start") + F.row_number().over(Window.partitionBy("name", "class", "sub").orderBy("key", "size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), "name").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rank", rank).withColumn("rate", rate).withColumn("offset", offset)
    copies = F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset"))
    return rows.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: docs' rows, each as often as the mix takes it; odd rows and tables as in mix_sources."""
    mixed = mix_sources(docs, **options)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = """
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS name,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
c AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY class, key, size) AS rank FROM c),
s AS (SELECT source, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source, name),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS k,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
    FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)),
f AS (SELECT min(k) AS k, min_by(level, k) AS level FROM l WHERE level * w <= cap),
t AS (SELECT name, source_size, CASE WHEN l.k < f.k THEN CAST(cap AS DOUBLE) ELSE f.level * w END AS target FROM l, f),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.rank, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || r.name), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS off FROM r JOIN t ON r.name = t.name)
SELECT doc_id, size, source_size, target,
    size * CAST(floor(rate * rank + off) - floor(rate * (rank - 1) + off) AS BIGINT) AS taken FROM x
"""
