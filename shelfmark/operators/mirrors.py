"""Mirrors and attempts: A1, A8, W1, W2, O1, O3, F10, J10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mirror_ok(status: Column, body: Column, marker: str) -> Column:
    """F10."""
    return F.coalesce((status == 200) & F.contains(body, F.lit(marker)), F.lit(False))


#: Parts that a mirror's log is dealt out in before the last probes of the whole are taken.
PARTS = 64


def probes_of(responses: DataFrame, marker: str) -> DataFrame:
    """F10 for A1: probe rows of responses (mirror, ts, status, body, ns), valid where the marker stands in a good body."""
    return responses.select("mirror", "ts", mirror_ok(F.col("status"), F.col("body"), marker).alias("ok"), "ns")


def last_probes(probes: DataFrame, n: int = 5) -> DataFrame:
    """The last n probes of each mirror; probes at one time count slowest first.

    Mirrors are few and their logs long: the last n of each of PARTS parts of a log are taken first, then
    those of these, so that no task sorts a whole log.
    """
    order = F.desc("row.ts"), F.desc("row.ns"), F.desc("row.ok")
    rows = probes.select(F.struct(*(F.col(f"`{c}`") for c in probes.columns)).alias("row"), F.pmod(F.xxhash64("ts", "ns"), F.lit(PARTS)).alias("part"))
    for keys in (("row.mirror", "part"), ("row.mirror",)):
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= n)
    return rows.select("row.*")


def _health(groups) -> DataFrame:
    return groups.agg(F.count("*").alias("n"), F.count_if("ok").alias("ok_count"), F.expr("sum(CASE WHEN ok THEN ns END) div nullif(count_if(ok), 0)").alias("avg_ns"))


def mirror_health(probes: DataFrame, n: int = 5, min_ok: int = 4) -> DataFrame:
    """A1 over W1: (mirror, avg_ns) of mirrors with enough successes."""
    return _health(last_probes(probes, n).groupBy("mirror")).where(F.col("ok_count") >= min_ok).select("mirror", "avg_ns")


def health_by_window(probes: DataFrame, duration: str = "10 minutes", min_ok: int = 4, share: float = 0.8) -> DataFrame:
    """T1 for batches and streams: health of each mirror in tumbling windows; for five probes as A1."""
    rows = probes.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", duration)
    rows = _health(rows.groupBy(F.window("ts", duration), "mirror"))
    return rows.where((F.col("ok_count") >= min_ok) & (F.col("ok_count") >= share * F.col("n"))).select(F.col("window.start").alias("start"), "mirror", "n", "ok_count", "avg_ns")


def rank_mirrors(health: DataFrame, k: int | None = None) -> DataFrame:
    """O1, O3: fastest first, ties by name; the k best if given."""
    out = health.orderBy("avg_ns", "mirror")
    return out if k is None else out.limit(k)


def first_success(attempts: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(path, mirror) of the best ranked success; null where none succeeded.

    ranks (mirror, rank) may come apart; mirrors are few, so Spark broadcasts it by its size. A mirror without a
    rank is none to turn to; a path that only such mirrors have stays, with null.
    """
    rows = attempts if ranks is None else attempts.drop("rank").join(ranks, "mirror", "left")
    best = F.min(F.when((F.col("status") == 200) & F.col("rank").isNotNull(), F.struct("rank", "mirror")))
    return rows.groupBy("path").agg(best.alias("b")).select("path", "b.mirror")


def attempt_outcome(log: DataFrame) -> DataFrame:
    """(path, outcome): success, gone (not found in a retry round), or failed."""
    ends = (F.col("status") == 200) | ((F.col("status") == 404) & (F.col("round") > 0))
    rows = log.groupBy("path").agg(F.min(F.when(ends, F.struct("round", "status"))).alias("e"))
    return rows.select("path", F.when(F.col("e").isNull(), "failed").when(F.col("e.status") == 200, "success").otherwise("gone").alias("outcome"))
