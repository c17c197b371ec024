"""Structured Streaming jobs T1-T3 over the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import partition_of
from ..operators.diff import detect_changes, latest, upsert_manifest
from ..operators.mirrors import health_by_window, rank_mirrors
from ..schemas import MANIFEST
from ..sources.shared_dir import settle
from ..sources.snapshots import Log, commit


def stream_mirror_health(probes: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, duration: str = "10 minutes") -> StreamingQuery:
    """Health by window; `publish` gets each batch's finished windows, ranked. Rows later than a window's length are dropped."""

    def send(batch: DataFrame, version: int) -> None:
        publish(rank_mirrors(batch), version)

    return health_by_window(probes, duration).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(send).trigger(availableNow=True).start()


def stream_upsert(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Each batch is a version of the manifest under root, which rewrites the roots that the batch touches. The
    log keeps the number of the stream's last batch, so that one that is run again changes nothing."""

    def send(batch: DataFrame, number: int) -> None:
        commit(batch.sparkSession, root, batch, batch=(checkpoint, number), merge=upsert_manifest)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send).trigger(availableNow=True).start()


def stream_changes(listing: DataFrame, local: DataFrame) -> DataFrame:
    """(path, action) of arriving listing rows against a static manifest."""
    return detect_changes(listing, local)


def stream_reconcile(listing: DataFrame, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """T3 against the live manifest: each batch's files are compared with the manifest under root as the batches
    before left it, the actions (batch, path, action) go to the folder `out`, and the new and changed ones
    into the manifest. A path that arrives twice is new once; within a batch its latest row counts.

    A batch that is run again reads the version from before its own commit and writes the same actions anew.
    """

    def send(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = Log(spark, root)
        rows = settle(latest(batch.select(*MANIFEST.fieldNames())), "arrivals")
        before, entry = log.latest()
        while entry["batches"].get(checkpoint, -1) >= number:
            before -= 1
            entry = log.entry(before) if before >= 0 else {"buckets": 1, "roots": {}, "batches": {}}
        touched = [r.root for r in rows.select(partition_of(F.col("path")).alias("root")).distinct().collect()]
        found = detect_changes(rows, log.table(entry, touched))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        found = spark.read.schema("path string, action string").parquet(f"{out}/batch={number}")
        commit(spark, root, rows.join(found.where("action <> 'same'").select("path"), "path", "left_semi"), batch=(checkpoint, number))

    return listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send).trigger(availableNow=True).start()
