"""Composed jobs E1-E5: DataFrames in, plans out; nothing but E5 runs before a sink."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ext
from ..operators import diff, finalise, verify
from ..sources import captured
from ..sources.shared_dir import settle


@dataclass
class Config:
    download_dir: str = "/download"
    media_dir: str = "/media"
    endpoint: str = "http://origin.local:5678"
    stream_root: str = "/d"
    new_endpoint: str = "http://origin.local:5678"
    new_root: str = "/d"
    roots: list[str] = field(default_factory=list)
    purge: bool = True
    keep_unverifiable: bool = False
    track_pointers: bool = False
    strict_prefix: bool = False
    on_listing_error: str = "fail"


def below(failed_listings: DataFrame) -> DataFrame:
    """(prefix) of what stands under each directory whose listing failed."""
    return failed_listings.select(F.concat(F.regexp_replace("path", r"/+\z", ""), F.lit("/")).alias("prefix"))


def download_plan(remote: DataFrame, local: DataFrame, stored: DataFrame | None = None, roots: DataFrame | list[str] | None = None, failed_listings: DataFrame | None = None, on_listing_error: str = "fail", snapshot: bool = False) -> DataFrame:
    """(path, action): new, changed, same, or delete for local rows that are gone.

    A failed listing (failed_listings has its directory as `path`) stops the plan before anything is written. If it
    is to be skipped, nothing below that directory counts as gone: what could not be listed is not deleted.
    `snapshot` says that local was read from a snapshot, of which only the selected roots' partitions are then read.
    """
    if failed_listings is not None and on_listing_error == "fail" and not failed_listings.isEmpty():
        raise RuntimeError("a directory listing failed")
    if roots is not None and (not isinstance(roots, list) or roots):
        remote, local = diff.prune_roots(remote, roots), diff.prune_roots(local, roots, snapshot=snapshot)
    old = local if stored is None else diff.only_stored(local, stored)
    gone = diff.stale(local, remote)
    if failed_listings is not None:
        gone = verify.exempt_by_prefix(gone, "path", below(failed_listings), "ancestors")
    return diff.detect_changes(remote, old).unionByName(gone.select("path", F.lit("delete").alias("action")))


def preserve_plan(files: DataFrame, content: DataFrame, dirs: DataFrame, entries: DataFrame, cfg: Config, path_skips: DataFrame | None = None, target_skips: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(preserve set, report of valid directories by root). Only pointers are ever dropped."""
    pointers, _ = verify.split_pointers(files)
    if not cfg.purge:
        return files.select("path"), verify.valid_dirs(pointers, purge=False, scan_dir=cfg.media_dir)
    checked = pointers if path_skips is None else verify.exempt_by_prefix(pointers, "path", path_skips)
    targets = verify.pointer_targets(verify.attach_content(checked, content), cfg.endpoint, cfg.stream_root, cfg.strict_prefix)
    if target_skips is not None:
        targets = verify.exempt_by_prefix(targets, "target", target_skips)
    states = verify.verify_pointers(targets, dirs, entries)
    drop = states.where(F.col("state").isin(["absent"] if cfg.keep_unverifiable else ["absent", "unverifiable"]))
    return diff.preserve(files, drop).select("path"), verify.valid_dirs(states, scan_dir=cfg.media_dir)


def preserve_from_pages(files: DataFrame, content: DataFrame, pages: DataFrame, cfg: Config, **skips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E2 straight from the catalog's captured pages: a pointer whose directory was listed in part is unverifiable, not absent."""
    return preserve_plan(files, content, captured.listing_status(pages), captured.catalog_entries(pages), cfg, **skips)


def update_plan(preserve: DataFrame, remote: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action): delete, pointer, new or changed."""
    known = diff.with_remote(preserve, remote)
    found = diff.detect_changes(known, target, diff.pointer_or_changed)
    found = found.withColumn("action", F.when(ext(F.col("path")) == verify.POINTER, "pointer").otherwise(F.col("action")))
    return diff.change_set(found, diff.purge(target, preserve))


def finalise_plan(updates: DataFrame, remote: DataFrame, target: DataFrame, content: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pointer output, copy plan, the target's new manifest)."""
    pointers, others = verify.split_pointers(updates.where("action <> 'delete'"))
    out = finalise.pointer_output(verify.attach_content(pointers, content), cfg.media_dir, cfg.endpoint, cfg.new_endpoint, cfg.new_root)
    plan = finalise.copy_plan(others, remote, cfg.download_dir, cfg.media_dir)
    changed = diff.with_remote(pointers.unionByName(others) if cfg.track_pointers else others, remote)
    kept = diff.delete_from_manifest(target, updates.where("action = 'delete'"))
    return out, plan, diff.upsert_manifest(kept, changed)


def reconcile(remote: DataFrame, local: DataFrame, target: DataFrame, content: DataFrame, dirs: DataFrame, entries: DataFrame, cfg: Config, mode: int = 7, stored: DataFrame | None = None, failed_listings: DataFrame | None = None, **skips: DataFrame) -> dict[str, DataFrame]:
    """E5: E1 to E4; mode & 4 discovers, mode & 1 synchronises.

    Under a directory whose listing failed, what is in the local manifest counts as still there for E2 to E4 as
    well, as E1 has it: the target's files are neither deleted nor forgotten. The files seen, these rows, the preserve
    set and the update plan are written out as they are made, since several later plans read each: left as plans,
    they would all be joined by path again in one stage, whose tasks hold every join's sort at once.
    """
    out: dict[str, DataFrame] = {}
    if mode & 4:
        out["download"] = download_plan(remote, local, stored, cfg.roots, failed_listings, cfg.on_listing_error)
    elif failed_listings is not None and cfg.on_listing_error == "fail" and not failed_listings.isEmpty():
        raise RuntimeError("a directory listing failed")
    if mode & 1:
        if failed_listings is not None:
            remote = settle(remote, "seen")
            unseen = diff.stale(verify.below_prefix(local, "path", below(failed_listings)), remote)
            remote = remote.unionByName(settle(unseen.select(*remote.columns), "unseen"))
        keep, out["report"] = preserve_plan(remote, content, dirs, entries, cfg, **skips)
        out["update"] = settle(update_plan(settle(keep, "keep"), remote, target), "update")
        out["pointers"], out["copies"], out["manifest"] = finalise_plan(out["update"], remote, target, content, cfg)
    return out
