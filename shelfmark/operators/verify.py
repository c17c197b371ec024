"""Pointer verification: F3-F5, F9, J5, J7, J8, A2-A6, O2, X1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, ext, root_of, walk_key
from ..functions.urls import pointer_target
from ..sources.shared_dir import settle

POINTER = ".strm"
#: Prefixes up to this many are compared one by one; more are joined with each path's ancestors.
FEW_PREFIXES = 64


def split_pointers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pointers, other files)."""
    pointer = ext(F.col("path")) == POINTER
    return df.where(pointer), df.where(~pointer)


def exempt_by_prefix(df: DataFrame, column: str, prefixes: DataFrame, strategy: str = "auto") -> DataFrame:
    """Rows whose path stands under none of the prefixes (which end in a slash).

    `broadcast` compares every row with every prefix, which only a short list allows, so that a longer
    one is refused; `ancestors` joins on each path's ancestors and holds for any number. `auto` looks at
    the list's length.
    """
    few = strategy != "ancestors" and len(prefixes.limit(FEW_PREFIXES + 1).collect()) <= FEW_PREFIXES
    if strategy == "broadcast" and not few:
        raise ValueError(f"more than {FEW_PREFIXES} prefixes are not broadcast")
    if few:
        names = prefixes.select(F.col("prefix").alias("_prefix")).distinct()
        return df.join(F.broadcast(names), F.startswith(df[column], F.col("_prefix")), "left_anti")
    return df.join(_keys_below(df, column, prefixes), df[column] == F.col("_key"), "left_anti")


def below_prefix(df: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """The other rows of exempt_by_prefix, for any number of prefixes: those whose path stands under one of them."""
    return df.join(_keys_below(df, column, prefixes), df[column] == F.col("_key"), "left_semi")


def _keys_below(df: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    names = prefixes.select(F.col("prefix").alias("_prefix")).distinct()
    under = df.select(F.col(column).alias("_key")).distinct().select("_key", F.explode(ancestors(F.col("_key"))).alias("_prefix"))
    return under.join(names, "_prefix", "left_semi").select("_key").distinct()


def attach_content(pointers: DataFrame, content: DataFrame) -> DataFrame:
    """Bodies of pointers; without one a pointer stays, unverified."""
    return pointers.join(content.select("path", "content"), "path", "left")


def pointer_targets(pointers: DataFrame, endpoint: str, root: str = "/d", strict: bool = False) -> DataFrame:
    """(path, target, dir, name) of the pointers to the known endpoint."""
    rows = pointers.withColumn("target", pointer_target(F.col("content"), endpoint, root, strict)).where("target IS NOT NULL")
    return rows.select("path", "target", dirname(F.col("target")).alias("dir"), basename(F.col("target")).alias("name"))


def verify_pointers(targets: DataFrame, dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, state): present, absent, or unverifiable where the directory could not be listed.

    Every pointer is verified, also those that share a target; an entry counts whatever its kind.
    """
    known = entries.select("dir", "name").distinct().withColumn("there", F.lit(True))
    status = dirs.groupBy("dir").agg(F.max("code").alias("code"))
    rows = targets.join(status, "dir", "left").join(known, ["dir", "name"], "left")
    state = F.when(F.col("code").isNull() | (F.col("code") != 200), "unverifiable").when(F.col("there"), "present").otherwise("absent")
    return rows.select("path", state.alias("state"))


def dir_contents(df: DataFrame) -> DataFrame:
    """A2: (dir, names), names in order; a row holds a whole directory, see dir_chunks for any size."""
    return df.groupBy(dirname(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_set(basename(F.col("path")))).alias("names"))


def targets_by_dir(targets: DataFrame) -> DataFrame:
    """A3: (dir, map of target name to pointer); of pointers with one target the last by path is named.

    A row holds a whole directory, see target_chunks for any size.
    """
    last = targets.groupBy("dir", "name").agg(F.max("path").alias("path"))
    return last.groupBy("dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "path")))).alias("targets"))


#: Names that one row of a directory's contents holds at most.
CHUNK_NAMES = 1000


def _ranked(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with `_rank`, the number (from 0) of a row among those of its key by `order`, which differs within a key.

    Rows are dealt out by ranges of both and written; ranks count within a key's part of a range, and go on
    from the sums of its earlier parts, so that a key with most of all rows is many tasks' work.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df.repartitionByRange(parts, key, order).withColumn("_range", F.spark_partition_id()), "ranked")
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(key, "_range").agg(F.count("*").alias("_n")).select(F.col(key), "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1
    return rows.withColumn("_inside", inside).join(first, [key, "_range"]).withColumn("_rank", F.col("_first") + F.col("_inside")).drop("_range", "_inside", "_first")


def dir_chunks(df: DataFrame, size: int = CHUNK_NAMES) -> DataFrame:
    """A2 for directories of any size: (dir, chunk, names): names in order, `size` of them in a row, chunks from 0."""
    names = df.select(dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("name")).distinct()
    rows = _ranked(names, "dir", "name").withColumn("chunk", F.floor(F.col("_rank") / size))
    return rows.groupBy("dir", "chunk").agg(F.array_sort(F.collect_list("name")).alias("names"))


def target_chunks(targets: DataFrame, size: int = CHUNK_NAMES) -> DataFrame:
    """A3 for directories of any size: (dir, chunk, map of target name to pointer), `size` names in a row; of pointers
    with one target the last by path is named."""
    last = targets.groupBy("dir", "name").agg(F.max("path").alias("path"))
    rows = _ranked(last, "dir", "name").withColumn("chunk", F.floor(F.col("_rank") / size))
    return rows.groupBy("dir", "chunk").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "path")))).alias("targets"))


def present_by_dir(states: DataFrame) -> DataFrame:
    """Present pointers of each pointer directory."""
    return states.where("state = 'present'").groupBy(dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))


def valid_dirs(states: DataFrame, purge: bool = True, scan_dir: str = "") -> DataFrame:
    """A4: (root, n) directories with a present pointer, or all pointer directories if nothing is purged."""
    rows = states.where("state = 'present'") if purge else states
    folder = dirname(F.col("path"))
    return rows.select(root_of(folder, scan_dir).alias("root"), folder.alias("dir")).distinct().groupBy("root").agg(F.count("*").alias("n"))


def totals(states: DataFrame, pointers: DataFrame, purge: bool = True) -> DataFrame:
    """A5: valid directories and all pointer directories."""
    valid = (states.where("state = 'present'") if purge else states).agg(F.count_distinct(dirname(F.col("path"))).alias("valid"))
    return valid.crossJoin(pointers.agg(F.count_distinct(dirname(F.col("path"))).alias("all_dirs")))  # two single rows


def walk_order(df: DataFrame, under: str = "/", keep: Column | None = None) -> DataFrame:
    """Pre-order walk of the tree under a path; where `keep` is not true, a visitor skips the entry and all
    that stands below it."""
    return _walked(df, under, keep).orderBy(walk_key(F.col("path")))


def _walked(df: DataFrame, under: str, keep: Column | None) -> DataFrame:
    stem = under.rstrip("/")
    rows = df.where((F.col("path") == (stem or "/")) | F.col("path").startswith(stem + "/"))
    if keep is None:
        return rows
    stays = F.coalesce(keep, F.lit(False))
    skipped = rows.where(~stays).select(F.concat(F.when(F.col("path") != "/", F.col("path")).otherwise(""), F.lit("/")).alias("prefix"))
    return exempt_by_prefix(rows.where(stays), "path", skipped, "ancestors")


def visited(df: DataFrame, verdict: Column, is_dir: Column, under: str = "/") -> DataFrame:
    """The entries of df (path, any more) that a visitor sees on its walk under a path.

    The verdict on an entry is `skip`, `stop` or anything else, null included, to go on. `skip` on a directory
    leaves out what stands below it, on a file the entries that follow in the file's own directory, with all
    below them. `stop` ends the walk. Entries with a verdict are seen themselves; one on an entry that isn't
    seen has no effect. A path of several rows is one entry, which skips or stops if any of its rows does.
    """
    rows = _walked(df, under, None).withColumns({"_verdict": verdict, "_dir": is_dir})
    path = F.col("path")
    skips = rows.where("_verdict = 'skip'")
    below = skips.where("_dir").select(F.concat(F.when(path != "/", path).otherwise(""), F.lit("/")).alias("prefix"))
    cuts = skips.where("NOT coalesce(_dir, false)").groupBy(dirname(path).alias("_in")).agg(F.min(basename(path)).alias("_least"))
    # Each element of a path is compared with the first file that skips in the directory in which it stands.
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("_in"), F.get(parts, n).alias("_name")))
    hit = rows.select("path", F.explode(steps).alias("_step")).select("path", "_step.*").join(cuts, "_in").where("_name > _least").select("path").distinct()
    seen = exempt_by_prefix(rows.join(hit, "path", "left_anti"), "path", below, "ancestors")
    seen = settle(seen, "visited")
    last = seen.where("_verdict = 'stop'").agg(F.min(walk_key(path))).first()[0]  # one path
    if last is not None:
        seen = seen.where(walk_key(path) <= F.array(*map(F.lit, last)))
    return seen.drop("_verdict", "_dir")


def walk_positions(df: DataFrame, under: str = "/", keep: Column | None = None) -> DataFrame:
    """O2 with each row's position (from 1) in the walk.

    Rows are dealt out by ranges of the walk's order and written; a range's first position is the sum
    of the rows of earlier ranges, so no task sees more than its range.
    """
    key = walk_key(F.col("path"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _walked(df, under, keep).withColumn("_key", key).repartitionByRange(parts, "_key").withColumn("_range", F.spark_partition_id())
    rows = settle(rows, "walk")
    first = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) + F.col("_first")
    return rows.join(F.broadcast(first), "_range").withColumn("position", place.cast("long")).drop("_key", "_range", "_first")
