"""Outputs: K3-K5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import rewrite_pointer


def pointer_output(pointers: DataFrame, media_dir: str, old_endpoint: str, new_endpoint: str, new_root: str) -> DataFrame:
    """K3: (target, content) of rewritten pointers (path, content)."""
    url = rewrite_pointer(F.col("content"), old_endpoint, new_endpoint, new_root)
    return pointers.where("content IS NOT NULL").select(F.concat(F.lit(media_dir.rstrip("/")), "path").alias("target"), F.concat(url, F.lit("\n")).alias("content"))


def copy_plan(updates: DataFrame, remote: DataFrame, download_dir: str, media_dir: str) -> DataFrame:
    """K4: (source, target) of files to copy, with their manifest rows for the upsert."""
    rows = remote.join(updates.select("path"), "path", "left_semi")
    return rows.select(F.concat(F.lit(download_dir.rstrip("/")), "path").alias("source"), F.concat(F.lit(media_dir.rstrip("/")), "path").alias("target"), "path", "name", "size", "modified", "etag")


def report_map(df: DataFrame) -> DataFrame:
    """K5: (root, n) as one map; there are as many entries as roots."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("root", "n")))).alias("valid"))


def write_report(df: DataFrame, path: str) -> None:
    """K5: JSON lines."""
    df.write.mode("overwrite").json(path)
