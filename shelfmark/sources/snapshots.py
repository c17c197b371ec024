"""Manifest snapshots K1: a log of versions, each naming the folder of every root; a writer rewrites the roots it touches."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import partition_of
from ..operators.diff import delete_from_manifest, latest, upsert_manifest
from ..schemas import MANIFEST, SNAPSHOT
from .shared_dir import _hadoop, settle

#: Buckets by path of a manifest that is new; a root has a file for each. An existing one keeps its number.
BUCKETS = 8
COLUMNS = MANIFEST.fieldNames()


class Log:
    """The versions of one manifest. Entry N is a JSON file: buckets, folder of each root, and the last batch
    of each stream. It is as long as there are roots, whose partitions Spark's driver lists in any case."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.at = _hadoop(spark, f"{self.path}/_log")

    def versions(self) -> list[int]:
        if not self.fs.exists(self.at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, version: int) -> dict:
        stream = self.fs.open(_hadoop(self.spark, f"{self.path}/_log/{version:020d}.json")[1])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self, buckets: int = BUCKETS) -> tuple[int, dict]:
        """(-1, an empty entry) if there is none."""
        found = self.versions()
        return (found[-1], self.entry(found[-1])) if found else (-1, {"buckets": buckets, "roots": {}, "batches": {}})

    def claim(self, version: int, entry: dict) -> bool:
        """Create the entry unless somebody has; it is whole from the moment that it is there.

        Of two writers one wins: the finished file gets its name by a link on local disks and by a rename
        elsewhere, which HDFS and ABFS refuse where the name is taken. Stores that rename by copying
        (s3a) don't, so that one writer at a time must be seen to there.
        """
        self.fs.mkdirs(self.at)
        draft = f"{self.path}/_log/.{uuid.uuid4().hex}"
        at, final = _hadoop(self.spark, draft)[1], _hadoop(self.spark, f"{self.path}/_log/{version:020d}.json")[1]
        out = self.fs.create(at, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(at.toUri().getPath(), final.toUri().getPath())
                return True
            return not self.fs.exists(final) and self.fs.rename(at, final)
        except FileExistsError:
            return False
        finally:
            self.fs.delete(at, False)

    # --- tables ---

    def _place(self, folder: str, root: str) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(root)
        return f"{self.path}/data/{folder}/root={escaped}"

    def table(self, entry: dict, roots: list[str] | None = None) -> DataFrame:
        """The rows of an entry, of some roots only if these are given: a table bucketed by path, so that joins on
        path leave it where it is, whose only partitions are the entry's."""
        name, quote = f"shelfmark_{uuid.uuid4().hex}", lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SNAPSHOT)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (root) CLUSTERED BY (path) SORTED BY (path) INTO {entry['buckets']} BUCKETS LOCATION {quote(self.path + '/data')}")
        live = [(r, f) for r, f in sorted(entry["roots"].items()) if roots is None or r in roots]
        for k in range(0, len(live), 200):
            parts = " ".join(f"PARTITION (root = {quote(r)}) LOCATION {quote(self._place(f, r))}" for r, f in live[k : k + 200])
            self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return self.spark.table(name)

    def put(self, rows: DataFrame, buckets: int) -> str:
        """Write rows with their root into a folder of its own; its name. Nothing refers to it before a claim does."""
        folder = uuid.uuid4().hex
        name = f"shelfmark_{folder}"
        rows.select(*COLUMNS, "root").write.format("parquet").partitionBy("root").bucketBy(buckets, "path").sortBy("path").option("path", f"{self.path}/data/{folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return folder

    def has(self, folder: str, root: str) -> bool:
        return self.fs.exists(_hadoop(self.spark, self._place(folder, root))[1])


def versions(spark: SparkSession, root: str) -> list[int]:
    return Log(spark, root).versions()


def read_manifest(spark: SparkSession, path: str, missing_ok: bool = False, version: int | None = None) -> DataFrame:
    """The latest snapshot under path, or the given one; none counts as empty if missing_ok."""
    log = Log(spark, path)
    found = log.versions() if version is None else [version]
    if found:
        return log.table(log.entry(found[-1]))
    if missing_ok:
        return spark.createDataFrame([], SNAPSHOT)
    raise FileNotFoundError(f"no finished snapshot under {path}")


def write_snapshot(df: DataFrame, root: str) -> int:
    """K1: a version with the rows of df alone; the versions before stay. Returns its number."""
    log = Log(df.sparkSession, root)
    number, entry = log.latest()
    rows = df.select(*COLUMNS).withColumn("root", partition_of(F.col("path")))
    folder = log.put(rows.repartition(entry["buckets"], "path"), entry["buckets"])
    names = [r.root for r in rows.select("root").distinct().collect()]  # as many as roots
    while not log.claim(number + 1, entry | {"roots": {r: folder for r in names}}):
        number, entry = log.latest()
    return number + 1


def commit(spark: SparkSession, root: str, changes: DataFrame | None = None, deletes: DataFrame | None = None, batch: tuple[str, int] | None = None, buckets: int = BUCKETS, merge: Callable[[DataFrame, DataFrame], DataFrame] = upsert_manifest) -> int:
    """K1, K2: a version in which the latest row of each path in `changes` replaces the one that was there and the
    paths in `deletes` are gone, unless they are among the changes too. Returns its number.

    Only the roots that these touch are read and written; the others' folders go on into the new version. The
    old rows don't shuffle: they are bucketed by path, and the new ones come to them. Of two writers the one that
    claims the next version first wins; the other goes on from there, and does its work anew only if a root
    of its own was touched meanwhile. `batch` (name of a stream, number) is done once: if the log has that
    number or a higher one, nothing happens. Rows without a path have no place in a manifest and go.
    """
    log = Log(spark, root)
    number, entry = log.latest(buckets)
    new = settle(latest((spark.createDataFrame([], MANIFEST) if changes is None else changes).select(*COLUMNS).where("path IS NOT NULL")), "manifest-changes")
    gone = settle((spark.createDataFrame([], MANIFEST) if deletes is None else deletes).select("path").where("path IS NOT NULL"), "manifest-deletes")
    names = new.select("path").unionByName(gone).select(partition_of(F.col("path")).alias("root")).distinct()
    touched = [r.root for r in names.collect()]  # as many as roots
    folder, base = None, {}
    while batch is None or entry["batches"].get(batch[0], -1) < batch[1]:
        if folder is None or any(entry["roots"].get(r) != base.get(r) for r in touched):
            base = entry["roots"]
            rows = log.table(entry, touched).select(*COLUMNS)
            if deletes is not None:
                rows = delete_from_manifest(rows, gone)
            folder = log.put(merge(rows, new).withColumn("root", partition_of(F.col("path"))), entry["buckets"])
            kept = [r for r in touched if log.has(folder, r)]
        roots = {r: f for r, f in entry["roots"].items() if r not in touched} | dict.fromkeys(kept, folder)
        if log.claim(number + 1, entry | {"roots": roots, "batches": entry["batches"] | dict([batch] if batch else [])}):
            return number + 1
        number, entry = log.latest(buckets)
    return number


def forget(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Delete all but the last `keep` versions, and the folders of roots that none of these names; how many folders.

    Not while a writer is at work, whose folder no version names yet.
    """
    log = Log(spark, root)
    found = log.versions()
    used = {f"{f}/{r}" for v in found[-keep:] for r, f in log.entry(v)["roots"].items()}
    old = {(f, r) for v in found[:-keep] for r, f in log.entry(v)["roots"].items() if f"{f}/{r}" not in used}
    for v in found[:-keep]:
        log.fs.delete(_hadoop(spark, f"{log.path}/_log/{v:020d}.json")[1], False)
    for f, r in old:
        log.fs.delete(_hadoop(spark, log._place(f, r))[1], True)
    return len(old)
