"""Changes between manifests: J1-J4, J6, J9, F1, F2, F6, U1-U4, K1, K2, W3, A7, A10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import TOP, dirname, elements, ext, root_of
from ..schemas import MANIFEST

#: Ignored folders and extensions that the original declares but never applies.
IGNORED_DIRS, IGNORED_EXTS = (".sync",), (".ass", ".srt", ".ssa")


#: Names of roots that a plan holds as a filter of partitions; more are joined.
FEW_ROOTS = 10_000


def is_changed(new: str = "new", old: str = "old") -> Column:
    """absent before, or later and of other size or etag."""
    n, o = (lambda c: F.col(f"{new}.{c}")), (lambda c: F.col(f"{old}.{c}"))
    return o("path").isNull() | ((n("modified") > o("modified")) & ((n("size") != o("size")) | (n("etag") != o("etag"))))


def pointer_or_changed(new: str = "new", old: str = "old") -> Column:
    """F6 of the update plan: pointers always count."""
    return is_changed(new, old) | (ext(F.col(f"{new}.path")) == ".strm")


def detect_changes(remote: DataFrame, local: DataFrame, predicate: Callable[[str, str], Column] = is_changed) -> DataFrame:
    """(path, action) of all remote files: new, changed or same."""
    both = remote.alias("new").join(local.alias("old"), F.col("new.path") == F.col("old.path"), "left")
    action = F.when(~predicate("new", "old"), "same").when(F.col("old.path").isNull(), "new").otherwise("changed")
    return both.select(F.col("new.path").alias("path"), action.alias("action"))


def stale(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local rows that the remote side no longer has."""
    return local.join(remote.select("path"), "path", "left_anti")


def purge(target: DataFrame, preserve: DataFrame) -> DataFrame:
    """Target rows outside the preserve set."""
    return target.join(preserve.select("path"), "path", "left_anti")


def preserve(all_files: DataFrame, to_skip: DataFrame) -> DataFrame:
    """All files but those to skip."""
    return all_files.join(to_skip.select("path"), "path", "left_anti")


def with_remote(paths: DataFrame, remote: DataFrame) -> DataFrame:
    """Manifest rows of the paths that the remote side knows."""
    return remote.join(paths.select("path"), "path", "left_semi")


def only_stored(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest rows whose file is really there."""
    return manifest.join(stored.select("path"), "path", "left_semi")


def normalise_roots(roots: list[str]) -> list[str]:
    """the first element of each given path."""
    return [parts[0] for r in roots if (parts := [p for p in r.split("/") if p])]


def prune_roots(df: DataFrame, roots: DataFrame | list[str], ignore: bool = False, snapshot: bool = False) -> DataFrame:
    """files under the selected roots, and those directly under `/`. Off by default: the ignored names.

    A snapshot's own `root` column prunes its partitions: the names are read when the plan is made, and are a filter
    unless there are more than FEW_ROOTS; any other table's column of that name is left alone.
    """
    if snapshot:
        names = roots if isinstance(roots, list) else [r.root for r in roots.select("root").where("root IS NOT NULL").distinct().limit(FEW_ROOTS + 1).collect()]
        if len(names) <= FEW_ROOTS:
            kept = df.where(F.col("root").isin([*(normalise_roots(names) if isinstance(roots, list) else names), TOP]))
        else:
            kept = df.join(roots.select("root").unionByName(df.sparkSession.range(1).select(F.lit(TOP).alias("root"))), "root", "left_semi").select(*df.columns)
    else:
        top, root = F.size(elements(F.col("path"))) <= 1, root_of(F.col("path"))
        if isinstance(roots, list):
            kept = df.where(top | root.isin(normalise_roots(roots)))
        else:
            names = roots.select(F.col("root").alias("_root"))
            kept = df.where(top).unionByName(df.where(~top).join(names, root == F.col("_root"), "left_semi"))
    if ignore:
        kept = kept.where(~F.arrays_overlap(elements(F.col("path")), F.array(*map(F.lit, IGNORED_DIRS))) & ~ext(F.col("path")).isin(*IGNORED_EXTS))
    return kept


def change_set(changes: DataFrame, deletes: DataFrame) -> DataFrame:
    """U4: (path, action) of inserts, updates and deletes."""
    return changes.where("action <> 'same'").select("path", "action").unionByName(deletes.select("path", F.lit("delete").alias("action")))


def union_paths(*sets: DataFrame) -> DataFrame:
    """The paths of any set, once."""
    out = sets[0].select("path")
    for s in sets[1:]:
        out = out.unionByName(s.select("path"))
    return out.dropDuplicates(["path"])


def latest(df: DataFrame, key: str = "path", seq: str = "modified") -> DataFrame:
    """The row of each key that was written last; a tie goes to the row that sorts last."""
    rest = [c for c in df.columns if c not in (key, seq)]
    return df.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("_last")).select(key, "_last.*").select(*df.columns)


def upsert_manifest(base: DataFrame, changes: DataFrame) -> DataFrame:
    """K1: rows of base whose path doesn't change, and the latest row of each path that does.

    One full join, so that a base that is bucketed by path stays where it is.
    """
    columns = MANIFEST.fieldNames()
    new = latest(changes.select(*columns)).select("path", F.struct(*columns).alias("_new"))
    both = base.select("path", F.struct(*columns).alias("_old")).join(new, "path", "full_outer")
    return both.select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")


def delete_from_manifest(base: DataFrame, keys: DataFrame) -> DataFrame:
    """K2."""
    return base.join(keys.select("path"), "path", "left_anti")


def action_counts(changes: DataFrame) -> DataFrame:
    """A7."""
    return changes.groupBy("action").agg(F.count("*").alias("n"))


def emptied_dirs(deleted: DataFrame, kept: DataFrame) -> DataFrame:
    """A10: directories of deleted files in which no kept file stands."""
    gone = deleted.select(dirname(F.col("path")).alias("dir")).distinct()
    return gone.join(kept.select(dirname(F.col("path")).alias("dir")).distinct(), "dir", "left_anti")
