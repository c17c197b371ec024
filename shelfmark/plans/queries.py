"""The registered queries of the catalog operators, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..fixtures import load, with_views
from ..functions import http, paths, urls
from ..operators import diff, finalise, mirrors, verify
from ..sources import captured, snapshots
from ..sources.shared_dir import scratch
from ..sources.tables import read_manifest, read_pointers, read_skip_list, stored_files, write_files
from ..streaming import jobs as streams
from . import jobs

CFG = jobs.Config(new_endpoint="http://media.local:8096", new_root="/dav")
QUERIES, ORACLES = {}, {}


def query(name: str, views: tuple[str, ...] = (), oracle: str | None = None):
    """Register a function of the views' DataFrames (the raw table `pages` may be one) as a query."""

    def put(f):
        def run(spark, sf_dir):
            return f(*(spark.read.parquet(f"{sf_dir}/pages.parquet") if v == "pages" else load(spark, sf_dir, v) for v in views))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = (with_views(*(v for v in views if v != "pages")) if views != ("pages",) else "") + oracle
        return f

    return put


_CHANGED = "(o.path IS NULL OR (n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag)))"
_CHANGES = f"SELECT n.path, CASE WHEN NOT {_CHANGED} THEN 'same' WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS action FROM remote_manifest n LEFT JOIN local_manifest o ON n.path = o.path"
_DIRNAME = "CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"
_TARGETS = """targets AS (SELECT path, replace(replace(rtrim(content, chr(10)), '%20', ' '), 'http://origin.local:5678/d', '') AS target FROM pointer_files),
parts AS (SELECT path, target, regexp_extract(target, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(target, '([^/]*)$', 1) AS name FROM targets),
states AS (SELECT p.path, CASE WHEN d.code IS NULL OR d.code <> 200 THEN 'unverifiable' WHEN e.name IS NOT NULL THEN 'present' ELSE 'absent' END AS state
    FROM parts p LEFT JOIN catalog_dirs d ON p.dir = d.dir LEFT JOIN (SELECT DISTINCT dir, name FROM catalog_entries) e ON p.dir = e.dir AND p.name = e.name)"""
_VERIFIED = ("pointer_files", "catalog_dirs", "catalog_entries")


def _states(pointers, dirs, entries):
    return verify.verify_pointers(verify.pointer_targets(pointers, CFG.endpoint), dirs, entries)


def _with(oracle: str) -> str:
    """Continue the WITH that comes before."""
    return ", " + oracle


@query("change_detection", ("remote_manifest", "local_manifest"), _CHANGES)
def change_detection(remote, local):
    return diff.detect_changes(remote, local)


@query("change_counts_by_root", ("remote_manifest", "local_manifest"), f"SELECT split_part(path, '/', 2) AS root, action, count(*) AS n FROM ({_CHANGES}) GROUP BY 1, 2")
def change_counts_by_root(remote, local):
    return diff.detect_changes(remote, local).groupBy(paths.root_of(F.col("path")).alias("root"), "action").agg(F.count("*").alias("n"))


@query("action_counts", ("remote_manifest", "local_manifest"), f"SELECT action, count(*) AS n FROM ({_CHANGES}) GROUP BY 1")
def action_counts(remote, local):
    return diff.action_counts(diff.detect_changes(remote, local))


@query("download_plan", ("remote_manifest", "local_manifest", "stored", "selected_roots"), """, r AS (SELECT * FROM remote_manifest WHERE split_part(path, '/', 2) IN (SELECT root FROM selected_roots)),
l AS (SELECT * FROM local_manifest WHERE split_part(path, '/', 2) IN (SELECT root FROM selected_roots)), s AS (SELECT * FROM l WHERE path IN (SELECT path FROM stored))
SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag) THEN 'changed' ELSE 'same' END AS action FROM r n LEFT JOIN s o ON n.path = o.path
UNION ALL SELECT path, 'delete' FROM l WHERE path NOT IN (SELECT path FROM r)""")
def download_plan(remote, local, stored, roots):
    return jobs.download_plan(remote, local, stored, roots)


@query("stale_files", ("local_manifest", "remote_manifest"), "SELECT * FROM local_manifest WHERE path NOT IN (SELECT path FROM remote_manifest)")
def stale_files(local, remote):
    return diff.stale(local, remote)


@query("purge_files", ("local_manifest", "stored"), "SELECT * FROM local_manifest WHERE path NOT IN (SELECT path FROM stored)")
def purge_files(local, keep):
    return diff.purge(local, keep)


_UPDATE = """SELECT n.path, CASE WHEN n.path LIKE '%.strm' THEN 'pointer' WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS action FROM remote_manifest n LEFT JOIN local_manifest o ON n.path = o.path
WHERE n.path LIKE '%.strm' OR o.path IS NULL OR (n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag))
UNION ALL SELECT path, 'delete' FROM local_manifest WHERE path NOT IN (SELECT path FROM remote_manifest)"""


@query("update_plan", ("remote_manifest", "local_manifest"), _UPDATE)
def update_plan(remote, local):
    return jobs.update_plan(remote, remote, local)


@query("preserve_set", ("remote_manifest", *_VERIFIED), _with(_TARGETS) + " SELECT path FROM remote_manifest WHERE path NOT IN (SELECT path FROM states WHERE state <> 'present')")
def preserve_set(remote, pointers, dirs, entries):
    return jobs.preserve_plan(remote, pointers, dirs, entries, CFG)[0]


@query("finalised_manifest", ("remote_manifest", "local_manifest", "pointer_files"), f""", u AS ({_UPDATE})
SELECT path, name, size, modified, etag FROM remote_manifest WHERE path IN (SELECT path FROM u WHERE action IN ('new', 'changed'))
UNION ALL SELECT path, name, size, modified, etag FROM local_manifest WHERE path NOT IN (SELECT path FROM u WHERE action <> 'pointer')""")
def finalised_manifest(remote, local, pointers):
    return jobs.finalise_plan(jobs.update_plan(remote, remote, local), remote, local, pointers, CFG)[2]


@query("reconciled_update", ("remote_manifest", "local_manifest", *_VERIFIED), _with(_TARGETS) + """, k AS (SELECT * FROM remote_manifest WHERE path NOT IN (SELECT path FROM states WHERE state <> 'present'))
SELECT n.path, CASE WHEN n.path LIKE '%.strm' THEN 'pointer' WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS action FROM k n LEFT JOIN local_manifest o ON n.path = o.path
WHERE n.path LIKE '%.strm' OR o.path IS NULL OR (n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag))
UNION ALL SELECT path, 'delete' FROM local_manifest WHERE path NOT IN (SELECT path FROM k)""")
def reconciled_update(remote, local, pointers, dirs, entries):
    return jobs.reconcile(remote, local, local, pointers, dirs, entries, CFG)["update"]


@query("pointer_targets", _VERIFIED, _with(_TARGETS) + " SELECT * FROM parts")
def pointer_targets(pointers, dirs, entries):
    return verify.pointer_targets(pointers, CFG.endpoint)


@query("verify_pointers", _VERIFIED, _with(_TARGETS) + " SELECT * FROM states")
def verify_pointers(pointers, dirs, entries):
    return _states(pointers, dirs, entries)


@query("skip_prefix_anti", ("remote_manifest", "skip_prefixes"), "SELECT * FROM remote_manifest r WHERE NOT EXISTS (SELECT 1 FROM skip_prefixes s WHERE starts_with(r.path, s.prefix))")
def skip_prefix_anti(remote, prefixes):
    return verify.exempt_by_prefix(remote, "path", prefixes, "ancestors")


@query("skip_prefix_few", ("remote_manifest", "skip_prefixes"), "SELECT * FROM remote_manifest r WHERE NOT EXISTS (SELECT 1 FROM skip_prefixes s WHERE starts_with(r.path, s.prefix))")
def skip_prefix_few(remote, prefixes):
    return verify.exempt_by_prefix(remote, "path", prefixes)


@query("valid_dirs_by_root", _VERIFIED, _with(_TARGETS) + f" SELECT split_part(path, '/', 2) AS root, count(DISTINCT {_DIRNAME}) AS n FROM states WHERE state = 'present' GROUP BY 1")
def valid_dirs_by_root(*frames):
    return verify.valid_dirs(_states(*frames))


@query("valid_dir_totals", _VERIFIED, _with(_TARGETS) + f" SELECT (SELECT count(DISTINCT {_DIRNAME}) FROM states WHERE state = 'present') AS valid, (SELECT count(DISTINCT {_DIRNAME}) FROM pointer_files) AS all_dirs")
def valid_dir_totals(pointers, dirs, entries):
    return verify.totals(_states(pointers, dirs, entries), pointers)


@query("present_by_dir", _VERIFIED, _with(_TARGETS) + f" SELECT {_DIRNAME} AS dir, count(*) AS n FROM states WHERE state = 'present' GROUP BY 1")
def present_by_dir(*frames):
    return verify.present_by_dir(_states(*frames))


@query("valid_dirs_report", _VERIFIED, _with(_TARGETS) + f" SELECT root || '=' || n AS line FROM (SELECT split_part(path, '/', 2) AS root, count(DISTINCT {_DIRNAME}) AS n FROM states WHERE state = 'present' GROUP BY 1)")
def valid_dirs_report(*frames):
    report = finalise.report_map(verify.valid_dirs(_states(*frames)))
    return report.select(F.explode("valid").alias("k", "v")).select(F.concat_ws("=", "k", F.col("v").cast("string")).alias("line"))


@query("dir_contents", ("remote_manifest",), f"SELECT {_DIRNAME} AS dir, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM remote_manifest GROUP BY 1")
def dir_contents(remote):
    return verify.dir_contents(remote).select("dir", F.array_join("names", ",").alias("names"))


@query("targets_by_dir", _VERIFIED, _with(_TARGETS) + " SELECT dir, string_agg(name || '=' || path, ',' ORDER BY name) AS targets FROM (SELECT dir, name, max(path) AS path FROM parts GROUP BY 1, 2) GROUP BY 1")
def targets_by_dir(pointers, dirs, entries):
    found = verify.targets_by_dir(verify.pointer_targets(pointers, CFG.endpoint))
    return found.select("dir", F.array_join(F.transform(F.map_entries("targets"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("targets"))


_OWN = "replace(replace(rtrim(content, chr(10)), '%20', ' '), 'http://origin.local:5678/d', '')"
_SPLIT = "regexp_extract(target, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(target, '([^/]*)$', 1) AS name"
#: States of pointers by the captured pages of the catalog.
_CAPTURED = f"""listings AS (SELECT dir, CASE WHEN NOT bool_and(json_type(body, '$.data') = 'OBJECT') THEN 404
    WHEN coalesce(sum(json_array_length(body, '$.data.content')), 0) < max(CAST(body->>'$.data.total' AS INTEGER)) THEN 206 ELSE max(CAST(body->>'$.code' AS INTEGER)) END AS code FROM catalog_pages GROUP BY dir),
listed AS (SELECT DISTINCT dir, e->>'$.name' AS name FROM (SELECT dir, unnest(CAST(json_extract(body, '$.data.content[*]') AS JSON[])) AS e FROM catalog_pages)),
targets AS (SELECT path, {_OWN} AS target FROM pointer_files), parts AS (SELECT path, {_SPLIT} FROM targets),
states AS (SELECT p.path, CASE WHEN l.code IS NULL OR l.code <> 200 THEN 'unverifiable' WHEN e.name IS NOT NULL THEN 'present' ELSE 'absent' END AS state
    FROM parts p LEFT JOIN listings l ON p.dir = l.dir LEFT JOIN listed e ON p.dir = e.dir AND p.name = e.name)"""


@query("captured_states", ("pointer_files", "catalog_pages"), _with(_CAPTURED) + " SELECT * FROM states")
def captured_states(pointers, pages):
    """A9 in J5: a pointer into a directory that was listed in part is unverifiable."""
    return verify.verify_pointers(verify.pointer_targets(pointers, CFG.endpoint), captured.listing_status(pages), captured.catalog_entries(pages))


@query("captured_preserve_set", ("remote_manifest", "pointer_files", "catalog_pages"), _with(_CAPTURED) + " SELECT path FROM remote_manifest WHERE path NOT IN (SELECT path FROM states WHERE state = 'absent')")
def captured_preserve_set(remote, pointers, pages):
    """E2 from captured pages, where what can't be verified is kept."""
    return jobs.preserve_from_pages(remote, pointers, pages, replace(CFG, keep_unverifiable=True))[0]


@query("preserve_set_target_skips", ("remote_manifest", *_VERIFIED, "skip_prefixes", "target_prefixes"), _with(_TARGETS) + """ SELECT path FROM remote_manifest WHERE path NOT IN (SELECT s.path FROM states s JOIN parts p ON s.path = p.path
WHERE s.state <> 'present' AND NOT EXISTS (SELECT 1 FROM target_prefixes t WHERE starts_with(p.target, t.prefix)))""")
def preserve_set_target_skips(remote, pointers, dirs, entries, _, skips):
    """pointers whose target stands under a skipped prefix are never dropped."""
    return jobs.preserve_plan(remote, pointers, dirs, entries, CFG, target_skips=skips)[0]


@query("pointer_targets_of_endpoint", ("pointer_files", "mixed_pointers"), f", targets AS (SELECT path, {_OWN} AS target FROM mixed_pointers WHERE starts_with(content, 'http://origin.local:5678')) SELECT path, target, {_SPLIT} FROM targets")
def pointer_targets_of_endpoint(_, pointers):
    """pointers to other endpoints have no target."""
    return verify.pointer_targets(pointers, CFG.endpoint)


@query("walk_order_pruned", ("remote_manifest", "tree"), """SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM tree
WHERE NOT (path IN ('/r8', '/r12/t12') OR starts_with(path, '/r8/') OR starts_with(path, '/r12/t12/'))""")
def walk_order_pruned(_, tree):
    """A directory that the visitor skips is left out with all below it."""
    return verify.walk_positions(tree, keep=~F.col("path").isin("/r8", "/r12/t12")).select("path", "position")


@query("walk_visited", ("remote_manifest", "tree"), """SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM tree t
WHERE NOT (starts_with(path, '/r8/') OR EXISTS (SELECT 1 FROM tree f WHERE f.path LIKE '%.nfo' AND regexp_extract(f.path, '^(.*)/', 1) = regexp_extract(t.path, '^(.*)/', 1) AND regexp_extract(t.path, '([^/]*)$', 1) > regexp_extract(f.path, '([^/]*)$', 1)))
AND string_split(path, '/') <= (SELECT min(string_split(path, '/')) FROM tree WHERE starts_with(path, '/r40/') AND path LIKE '%.strm')""")
def walk_visited(_, tree):
    """What a visitor sees that skips a directory, skips from a file on, and stops at a file."""
    file = F.col("path").rlike(r"\.[a-z]+$")
    verdict = F.when(F.col("path") == "/r8", "skip").when(F.col("path").endswith(".nfo"), "skip").when(F.col("path").startswith("/r40/") & F.col("path").endswith(".strm"), "stop")
    return verify.walk_positions(verify.visited(tree, verdict, ~file)).select("path", "position")


@query("dir_content_chunks", ("remote_manifest",), f"""SELECT dir, chunk, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT dir, name, (row_number() OVER (PARTITION BY dir ORDER BY name) - 1) // 3 AS chunk
FROM (SELECT DISTINCT {_DIRNAME} AS dir, name FROM remote_manifest)) GROUP BY 1, 2""")
def dir_content_chunks(remote):
    """A2 in rows of three names."""
    return verify.dir_chunks(remote, 3).select("dir", "chunk", F.array_join("names", ",").alias("names"))


@query("target_chunks_by_root", _VERIFIED, _with(_TARGETS) + """ SELECT dir, chunk, string_agg(name || '=' || path, ',' ORDER BY name) AS targets FROM (SELECT dir, name, path, (row_number() OVER (PARTITION BY dir ORDER BY name) - 1) // 4 AS chunk
FROM (SELECT regexp_extract(dir, '^(/[^/]*/[^/]*)', 1) AS dir, name, max(path) AS path FROM parts GROUP BY 1, 2)) GROUP BY 1, 2""")
def target_chunks_by_root(pointers, dirs, entries):
    """A3 in rows of four names, all targets of a root together."""
    targets = verify.pointer_targets(pointers, CFG.endpoint).withColumn("dir", F.regexp_extract("dir", "^(/[^/]*/[^/]*)", 1))
    pairs = F.transform(F.map_entries("targets"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return verify.target_chunks(targets, 4).select("dir", "chunk", F.array_join(pairs, ",").alias("targets"))


@query("odd_page_links", ("odd_pages",), """, a AS (SELECT path AS base, regexp_extract(html, 'right([0-9]+)', 1) AS id FROM odd_pages), b AS (SELECT base, 'right' || id || '.txt' AS name, false AS is_dir FROM a UNION ALL SELECT base, 'bare' || id || '.txt', false FROM a
UNION ALL SELECT base, 'code' || id || '.txt', false FROM a UNION ALL SELECT base, 'café' || id, true FROM a) SELECT concat('http://origin.local', base, '/') AS url, base || '/' || name AS path, name, is_dir FROM b""")
def odd_page_links(pages):
    """S5 of pages with other attributes, bare and quoted values, references, raw text and a tag that never ends."""
    return captured.extract_links(pages).select("url", "path", "name", "is_dir")


_SETS = """, p AS (SELECT DISTINCT dir, page, json_extract_string(body, '$.data.content[0].name') AS name FROM page_sets)"""


@query("page_set_completeness", ("page_sets",), _SETS + " SELECT dir, min(page) = 1 AND max(page) = count(DISTINCT page) AND count(DISTINCT name) >= 12 AS complete FROM p GROUP BY dir")
def page_set_completeness(pages):
    """A9 of listings of twelve pages, some repeated, some missing, some with a name that another page has."""
    return captured.listing_complete(pages)


@query("page_set_entries", ("page_sets",), _SETS + " SELECT dir, name, CAST(1 AS BIGINT) AS size, epoch_us(TIMESTAMP '2024-01-02 00:00:00') AS modified_us, false AS is_dir FROM p")
def page_set_entries(pages):
    """S7 of the same: pages captured twice count once."""
    return captured.catalog_entries(pages).select("dir", "name", "size", F.unix_micros("modified").alias("modified_us"), "is_dir")


@query("catalog_entry_times", ("catalog_pages",), """SELECT dir, e->>'$.name' AS name, epoch_us(CAST(e->>'$.modified' AS TIMESTAMPTZ)) AS modified_us, CAST(e->>'$.is_dir' AS BOOLEAN) AS is_dir
FROM (SELECT dir, unnest(CAST(json_extract(body, '$.data.content[*]') AS JSON[])) AS e FROM catalog_pages)""")
def catalog_entry_times(pages):
    """Times with fractions and zones."""
    return captured.catalog_entries(pages).select("dir", "name", F.unix_micros("modified").alias("modified_us"), "is_dir")


_NOT_FAILED = "NOT (starts_with(path, '/r0/stale/') OR starts_with(path, '/r4/') OR starts_with(path, '/nowhere/'))"


@query("download_plan_skip", ("remote_manifest", "local_manifest", "stored", "failed_dirs"), f""", s AS (SELECT * FROM local_manifest WHERE path IN (SELECT path FROM stored)), r AS (SELECT * FROM remote_manifest WHERE {_NOT_FAILED})
SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag) THEN 'changed' ELSE 'same' END AS action FROM r n LEFT JOIN s o ON n.path = o.path
UNION ALL SELECT path, 'delete' FROM local_manifest WHERE path NOT IN (SELECT path FROM r) AND {_NOT_FAILED}""")
def download_plan_skip(remote, local, stored, failed):
    """E1 where listings failed: their directories' files aren't seen, and none of them is deleted."""
    seen = verify.exempt_by_prefix(remote, "path", jobs.below(failed), "ancestors")
    return jobs.download_plan(seen, local, stored, failed_listings=failed, on_listing_error="skip")


_FAILED = """r AS (SELECT path, name, size, modified, etag FROM remote_manifest WHERE {0} UNION ALL SELECT path, name, size, modified, etag FROM local_manifest WHERE NOT ({0})),
k AS (SELECT * FROM r WHERE path NOT IN (SELECT path FROM states WHERE state <> 'present')),
u AS (SELECT n.path, CASE WHEN n.path LIKE '%.strm' THEN 'pointer' WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS action FROM k n LEFT JOIN local_manifest o ON n.path = o.path
WHERE n.path LIKE '%.strm' OR o.path IS NULL OR (n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag))
UNION ALL SELECT path, 'delete' FROM local_manifest WHERE path NOT IN (SELECT path FROM k))""".format(_NOT_FAILED)


def _after_failures(remote, local, pointers, dirs, entries, stored, failed, mode):
    seen = verify.exempt_by_prefix(remote, "path", jobs.below(failed), "ancestors")
    return jobs.reconcile(seen, local, local, pointers, dirs, entries, replace(CFG, on_listing_error="skip"), mode, stored, failed)


@query("reconciled_update_after_failures", ("remote_manifest", "local_manifest", *_VERIFIED, "stored", "failed_dirs"), _with(_TARGETS) + ", " + _FAILED + " SELECT * FROM u")
def reconciled_update_after_failures(*frames):
    """E5 that only synchronises: the update where listings failed."""
    return _after_failures(*frames, mode=1)["update"]


@query("reconciled_manifest_after_failures", ("remote_manifest", "local_manifest", *_VERIFIED, "stored", "failed_dirs"), _with(_TARGETS) + ", " + _FAILED + """ SELECT path, name, size, modified, etag FROM r WHERE path IN (SELECT path FROM u WHERE action IN ('new', 'changed'))
UNION ALL SELECT path, name, size, modified, etag FROM local_manifest WHERE path NOT IN (SELECT path FROM u WHERE action <> 'pointer')""")
def reconciled_manifest_after_failures(*frames):
    """E5: the target's manifest where listings failed."""
    return _after_failures(*frames, mode=7)["manifest"]


@query("reconciled_pointers", ("remote_manifest", "local_manifest", *_VERIFIED, "stored", "failed_dirs"), _with(_TARGETS) + ", " + _FAILED + """ SELECT '/media' || path AS target, 'http://media.local:8096/dav' || replace(replace(rtrim(content, chr(10)), 'http://origin.local:5678/d', ''), ' ', '%20') || chr(10) AS content FROM pointer_files WHERE path IN (SELECT path FROM u WHERE action = 'pointer')""")
def reconciled_pointers(*frames):
    """E5: the pointers to write; those without a body have none."""
    return _after_failures(*frames, mode=1)["pointers"].where("content IS NOT NULL")


@query("reconciled_download", ("remote_manifest", "local_manifest", *_VERIFIED, "stored", "failed_dirs"), _with(_TARGETS) + f""", s AS (SELECT * FROM local_manifest WHERE path IN (SELECT path FROM stored)), r AS (SELECT * FROM remote_manifest WHERE {_NOT_FAILED})
SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag) THEN 'changed' ELSE 'same' END AS action FROM r n LEFT JOIN s o ON n.path = o.path
UNION ALL SELECT path, 'delete' FROM local_manifest WHERE path NOT IN (SELECT path FROM r) AND {_NOT_FAILED}""")
def reconciled_download(*frames):
    """E5 that only discovers, with the files that are really stored."""
    return _after_failures(*frames, mode=4)["download"]


@query("selected_root_paths", ("remote_manifest",), "SELECT * FROM remote_manifest WHERE split_part(path, '/', 2) IN ('r0', 'r4', 'r12')")
def selected_root_paths(remote):
    """roots given as paths."""
    return diff.prune_roots(remote, ["/r0/t0/", "r4", "//r12", "/", ""])


@query("typed_index_links", ("typed_pages",), r""", a AS (SELECT page_id, content_type, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS page, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM typed_pages WHERE starts_with(content_type, 'text/html')),
b AS (SELECT page_id, content_type, CASE WHEN rtrim(page, '/') = '' THEN '/' ELSE rtrim(page, '/') END AS base, regexp_extract(href, '^([^?#]*)', 1) AS written FROM a),
c AS (SELECT *, CASE WHEN rtrim(written, '/') = '' THEN '/' ELSE rtrim(written, '/') END AS target FROM b)
SELECT page_id, content_type, CASE WHEN base = '/' THEN '' ELSE base END || '/' || regexp_extract(target, '([^/]*)$', 1) AS path, regexp_extract(target, '([^/]*)$', 1) AS name, ends_with(written, '/') AS is_dir
FROM c WHERE NOT (target = base OR target = '/' OR starts_with(base, target || '/'))""")
def typed_index_links(pages):
    """F8: listings that aren't HTML are empty."""
    return captured.extract_links(pages).drop("url")


@query("link_kinds", ("index_pages",), r""", a AS (SELECT path, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS written FROM index_pages)
SELECT path, written, CASE WHEN ends_with(written, '/') THEN 'dir' WHEN regexp_extract(written, '([^/]*)$', 1) NOT IN ('.', '..') THEN 'file' END AS kind FROM a""")
def link_kinds(pages):
    """P4 of all links of the pages, as they are written."""
    found = pages.select("path", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("written"))
    return found.select("path", "written", urls.link_kind(F.col("written")).alias("kind"))


@query("listing_lines_of_responses", ("header_responses",), "SELECT CASE WHEN starts_with(content_type, 'text/html') THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END || chr(9) || path AS line FROM header_responses")
def listing_lines_of_responses(responses):
    """P18 of files and directories."""
    return http.listing_line(captured.files_from_headers(responses))


@query("stored_pointer_files", ("pointer_files",), "SELECT path, content FROM pointer_files")
def stored_pointer_files(pointers):
    """Pointers written as files and read back."""
    return read_pointers(pointers.sparkSession, _stored(pointers))


@query("stored_file_lengths", ("pointer_files",), "SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS length FROM pointer_files")
def stored_file_lengths(pointers):
    """Paths and lengths of stored files."""
    return stored_files(pointers.sparkSession, _stored(pointers))


def _stored(pointers):
    """A folder with each pointer as a file."""
    base = scratch(pointers.sparkSession, "pointers")
    written = write_files(pointers.select(F.col("path").alias("target"), "content"), base)
    written.agg(F.sum("length")).collect()  # one number: the files are there
    return base


@query("skip_list_file", ("skip_lines",), "SELECT DISTINCT '/' || trim(trim(line), '/') || '/' AS prefix FROM skip_lines WHERE trim(line) NOT IN ('', '/')")
def skip_list_file(lines):
    """The skip list as a text file."""
    path = scratch(lines.sparkSession, "skip-list")
    lines.select("line").write.text(path)
    return read_skip_list(lines.sparkSession, path)


@query("valid_dirs_report_file", _VERIFIED, _with(_TARGETS) + f" SELECT split_part(path, '/', 2) AS root, count(DISTINCT {_DIRNAME}) AS n FROM states WHERE state = 'present' GROUP BY 1")
def valid_dirs_report_file(*frames):
    """K5: the report as JSON lines."""
    found = verify.valid_dirs(_states(*frames))
    path = scratch(found.sparkSession, "report")
    finalise.write_report(found, path)
    return found.sparkSession.read.schema("root string, n long").json(path)


@query("failover_by_ranks", ("mirror_attempts", "mirror_ranks"), "SELECT a.path, min_by(a.mirror, r.rank) FILTER (WHERE a.status = 200) AS mirror FROM mirror_attempts a JOIN mirror_ranks r ON a.mirror = r.mirror GROUP BY a.path")
def failover_by_ranks(attempts, ranks):
    """J10 with ranks from a ranking of their own."""
    return mirrors.first_success(attempts, ranks)


_HEALTH = """SELECT mirror, CAST(sum(ns) FILTER (WHERE ok) // count(*) FILTER (WHERE ok) AS BIGINT) AS avg_ns FROM (SELECT *, row_number() OVER (PARTITION BY mirror ORDER BY ts DESC, ns DESC, ok DESC) AS k FROM mirror_probes) WHERE k <= 5 GROUP BY mirror HAVING count(*) FILTER (WHERE ok) >= 4"""


@query("mirror_ranking", ("mirror_probes",), f"SELECT mirror, avg_ns, row_number() OVER (ORDER BY avg_ns, mirror) AS rank FROM ({_HEALTH})")
def mirror_ranking(probes):
    from pyspark.sql import Window

    return mirrors.mirror_health(probes).select("mirror", "avg_ns", F.row_number().over(Window.orderBy("avg_ns", "mirror")).cast("long").alias("rank"))


@query("mirror_health_of_responses", ("mirror_responses",), f""", mirror_probes AS (SELECT mirror, ts, status = 200 AND contains(body, 'films/') AS ok, ns FROM mirror_responses) {_HEALTH}""")
def mirror_health_of_responses(responses):
    """F10 in A1: what a probe answers decides whether it counts."""
    return mirrors.mirror_health(mirrors.probes_of(responses, "films/"))


@query("best_mirrors", ("mirror_probes",), f"SELECT mirror, avg_ns FROM ({_HEALTH}) ORDER BY avg_ns, mirror LIMIT 3")
def best_mirrors(probes):
    return mirrors.rank_mirrors(mirrors.mirror_health(probes), 3)


_HEALTH_BY_DAY = """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, mirror, count(*) AS n, count(*) FILTER (WHERE ok) AS ok_count,
CAST(sum(ns) FILTER (WHERE ok) // count(*) FILTER (WHERE ok) AS BIGINT) AS avg_ns FROM mirror_probes GROUP BY 1, 2 HAVING count(*) FILTER (WHERE ok) >= 4 AND count(*) FILTER (WHERE ok) >= 0.8 * count(*)"""


@query("mirror_health_window", ("mirror_probes",), _HEALTH_BY_DAY)
def mirror_health_window(probes):
    return mirrors.health_by_window(probes, "1 day").withColumn("start", F.unix_timestamp("start"))


@query("failover_first_success", ("mirror_attempts",), "SELECT path, min_by(mirror, rank) FILTER (WHERE status = 200) AS mirror FROM mirror_attempts GROUP BY path")
def failover_first_success(attempts):
    return mirrors.first_success(attempts)


@query("attempt_rollup", ("retry_log",), """SELECT path, CASE min_by(status, round) FILTER (WHERE status = 200 OR (status = 404 AND round > 0)) WHEN 200 THEN 'success' WHEN 404 THEN 'gone' ELSE 'failed' END AS outcome FROM retry_log GROUP BY path""")
def attempt_rollup(log):
    return mirrors.attempt_outcome(log)


@query("listing_completeness", ("catalog_pages",), "SELECT dir, sum(json_array_length(body, '$.data.content')) >= max(CAST(body->>'$.data.total' AS INTEGER)) AS complete FROM catalog_pages GROUP BY dir")
def listing_completeness(pages):
    return captured.listing_complete(pages)


@query("catalog_json_entries", ("catalog_pages",), """SELECT dir, e->>'$.name' AS name, CAST(e->>'$.size' AS BIGINT) AS size, CAST(e->>'$.is_dir' AS BOOLEAN) AS is_dir
FROM (SELECT dir, unnest(CAST(json_extract(body, '$.data.content[*]') AS JSON[])) AS e FROM catalog_pages)""")
def catalog_json_entries(pages):
    return captured.catalog_entries(pages).drop("modified")


@query("catalog_dir_status", ("catalog_pages",), "SELECT dir, CASE WHEN bool_and(json_type(body, '$.data') = 'OBJECT') THEN max(CAST(body->>'$.code' AS INTEGER)) ELSE 404 END AS code FROM catalog_pages GROUP BY dir")
def catalog_dir_status(pages):
    return captured.catalog_dirs(pages)


@query("catalog_stat", ("stat_responses",), """SELECT path, body->>'$.data.name' AS name, CAST(body->>'$.data.size' AS BIGINT) AS size, CASE WHEN json_type(body, '$.data') = 'OBJECT' THEN 'found' ELSE 'not_found' END AS state FROM stat_responses""")
def catalog_stat(responses):
    return captured.catalog_stat(responses).drop("modified", "is_dir")


_KEPT = "SELECT path, name, size, modified, etag FROM local_manifest WHERE path NOT IN (SELECT path FROM remote_manifest) UNION ALL SELECT path, name, size, modified, etag FROM remote_manifest"


@query("manifest_upsert", ("local_manifest", "remote_manifest"), _KEPT)
def manifest_upsert(local, remote):
    return diff.upsert_manifest(local, remote)


@query("manifest_delete", ("local_manifest", "stored"), "SELECT * FROM local_manifest WHERE path NOT IN (SELECT path FROM stored)")
def manifest_delete(local, keys):
    return diff.delete_from_manifest(local, keys)


@query("manifest_lookup", ("stored", "local_manifest"), "SELECT * FROM local_manifest WHERE path IN (SELECT path FROM stored)")
def manifest_lookup(keys, local):
    from ..sources.tables import lookup

    return lookup(keys, local)


@query("latest_version", ("remote_manifest", "local_manifest"), """, a AS (SELECT * FROM remote_manifest UNION ALL SELECT * FROM local_manifest)
SELECT path, name, size, modified, etag FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY modified DESC, name DESC, size DESC, etag DESC) AS k FROM a) WHERE k = 1""")
def latest_version(remote, local):
    return diff.latest(remote.unionByName(local))


@query("walk_order", ("tree",), "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM tree")
def walk_order(tree):
    """O2 of the whole tree, directories and files."""
    return verify.walk_positions(tree).select("path", "position")


@query("walk_order_all", ("remote_manifest",), "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM remote_manifest")
def walk_order_all(remote):
    """O2 of all files."""
    return verify.walk_positions(remote).select("path", "position")


@query("selected_roots", ("remote_manifest", "selected_roots"), "SELECT * FROM remote_manifest WHERE split_part(path, '/', 2) IN (SELECT root FROM selected_roots)")
def selected_roots(remote, roots):
    return diff.prune_roots(remote, roots)


@query("path_union", ("remote_manifest", "local_manifest"), "SELECT path FROM remote_manifest UNION SELECT path FROM local_manifest")
def path_union(remote, local):
    return diff.union_paths(remote, local)


@query("index_links", ("pages",), r"""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS page, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM pages),
b AS (SELECT page_id, CASE WHEN rtrim(page, '/') = '' THEN '/' ELSE rtrim(page, '/') END AS base, regexp_extract(href, '^([^?#]*)', 1) AS written FROM a),
c AS (SELECT *, CASE WHEN rtrim(written, '/') = '' THEN '/' ELSE rtrim(written, '/') END AS target FROM b)
SELECT page_id, CASE WHEN base = '/' THEN '' ELSE base END || '/' || regexp_extract(target, '([^/]*)$', 1) AS path, regexp_extract(target, '([^/]*)$', 1) AS name, ends_with(written, '/') AS is_dir
FROM c WHERE NOT (target = base OR target = '/' OR starts_with(base, target || '/'))""")
def index_links(pages):
    return captured.extract_links(pages).drop("url")


@query("index_page_links", ("index_pages",), r""", a AS (SELECT path AS base, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM index_pages),
b AS (SELECT base, rtrim(href, '/') AS t, ends_with(href, '/') AS is_dir FROM a WHERE href <> '../' AND href NOT LIKE '?%')
SELECT concat('http://origin.local', base, '/') AS url, concat(base, '/', regexp_extract(t, '([^/]*)$', 1)) AS path, regexp_extract(t, '([^/]*)$', 1) AS name, is_dir FROM b""")
def index_page_links(pages):
    return captured.extract_links(pages)


@query("header_records", ("header_responses",), r"""SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN starts_with(content_type, 'text/html') THEN 128 ELSE coalesce(TRY_CAST(nullif(content_length, '') AS BIGINT), 0) END AS size,
coalesce(CAST(epoch(try_strptime(nullif(last_modified, ''), '%a, %d %b %Y %H:%M:%S GMT')) AS BIGINT), -62135596800) AS modified, etag, starts_with(content_type, 'text/html') AS is_dir FROM header_responses""")
def header_records(responses):
    return captured.files_from_headers(responses)


@query("header_files", ("header_responses",), "SELECT path, content_type FROM header_responses WHERE NOT starts_with(content_type, 'text/html')")
def header_files(responses):
    return captured.drop_html(responses).select("path", "content_type")


@query("pointer_rewrite", ("pointer_files",), """SELECT '/media' || path AS target, 'http://media.local:8096/dav' || replace(replace(rtrim(content, chr(10)), 'http://origin.local:5678/d', ''), ' ', '%20') || chr(10) AS content FROM pointer_files""")
def pointer_rewrite(pointers):
    return finalise.pointer_output(pointers, CFG.media_dir, CFG.endpoint, CFG.new_endpoint, CFG.new_root)


@query("fetch_urls", ("pointer_files",), "SELECT path, 'http://origin.local:5678' || replace(regexp_extract(content, '(/media%20lib[^\\n]*)', 1), '%20', '%20') AS url FROM pointer_files")
def fetch_urls(pointers):
    target = urls.pointer_target(F.col("content"), CFG.endpoint)
    return pointers.select("path", urls.fetch_url(F.lit("http://origin.local:5678/"), target).alias("url"))


@query("endpoint_check", ("pages",), "SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) IN ('', '/') AS valid FROM pages")
def endpoint_check(pages):
    return pages.select("page_id", urls.endpoint_valid(F.col("url")).alias("valid"))


@query("path_parts", ("remote_manifest",), f"SELECT path, {_DIRNAME} AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, split_part(path, '/', 2) AS root FROM remote_manifest")
def path_parts(remote):
    p = F.col("path")
    return remote.select(paths.clean_path(F.concat(p, F.lit("/x/../."))).alias("path"), paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), paths.ext(p).alias("ext"), paths.root_of(p).alias("root"))


@query("skip_list_normalise", ("skip_lines",), "SELECT DISTINCT '/' || trim(trim(line), '/') || '/' AS prefix FROM skip_lines WHERE trim(line) NOT IN ('', '/')")
def skip_list_normalise(lines):
    return lines.select(paths.normalise_prefix(F.col("line")).alias("prefix")).where("prefix IS NOT NULL").distinct()


@query("copy_plan", ("remote_manifest", "local_manifest"), f""", u AS ({_UPDATE})
SELECT '/download' || path AS source, '/media' || path AS target, path, name, size, modified, etag FROM remote_manifest WHERE path IN (SELECT path FROM u WHERE action IN ('new', 'changed'))""")
def copy_plan(remote, local):
    updates = jobs.update_plan(remote, remote, local).where("action IN ('new', 'changed')")
    return finalise.copy_plan(updates, remote, CFG.download_dir, CFG.media_dir)


@query("empty_dirs", ("local_manifest", "remote_manifest"), f"""SELECT DISTINCT {_DIRNAME} AS dir FROM local_manifest WHERE path NOT IN (SELECT path FROM remote_manifest) AND {_DIRNAME} NOT IN (SELECT {_DIRNAME} FROM local_manifest WHERE path IN (SELECT path FROM remote_manifest))""")
def empty_dirs(local, remote):
    return diff.emptied_dirs(diff.stale(local, remote), diff.with_remote(local, remote))


@query("listing_lines", ("remote_manifest",), "SELECT '-rw-r--r--' || chr(9) || path AS line FROM remote_manifest")
def listing_lines(remote):
    return http.listing_line(remote.withColumn("is_dir", F.lit(False)))


@query("modified_times", ("remote_manifest",), "SELECT path, strftime(make_timestamp(modified * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM remote_manifest")
def modified_times(remote):
    return remote.select("path", http.rfc3339_nano(http.mod_time(F.col("modified"))).alias("at"))


@query("storage_presence", ("local_manifest", "stored"), "SELECT * FROM local_manifest WHERE path IN (SELECT path FROM stored)")
def storage_presence(local, stored):
    return diff.only_stored(local, stored)


@query("change_set", ("remote_manifest", "local_manifest"), f"SELECT * FROM ({_CHANGES}) WHERE action <> 'same' UNION ALL SELECT path, 'delete' FROM local_manifest WHERE path NOT IN (SELECT path FROM remote_manifest)")
def change_set(remote, local):
    return diff.change_set(diff.detect_changes(remote, local), diff.stale(local, remote))


def _stream(df):
    """df as files, read as a stream of several batches."""
    path = scratch(df.sparkSession, "stream")
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _arrive(frames, process):
    """Write each frame's files once those of the frames before are processed, and process() what is there:
    batches come in the frames' order, whatever the times of files."""
    spark = frames[0].sparkSession
    path = scratch(spark, "stream")
    for df in frames:
        df.write.mode("append").parquet(path)
        process(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


@query("stream_upsert", ("local_manifest", "remote_manifest"), _KEPT)
def stream_upsert(local, remote):
    """The local manifest and then the remote one arrive as files; the last snapshot is what K1 gives."""
    spark = local.sparkSession
    root, notes = scratch(spark, "snapshots"), scratch(spark, "upsert-notes")
    _arrive([local, remote.select(local.columns)], lambda arrived: streams.stream_upsert(arrived, root, notes))
    return read_manifest(spark, root).drop("root")


@query("stream_change_detection", ("remote_manifest", "local_manifest"), _CHANGES)
def stream_change_detection(remote, local):
    """Arriving listing rows against the local manifest."""
    spark = remote.sparkSession
    out = scratch(spark, "changes")
    found = streams.stream_changes(_stream(remote.repartition(2, "path")), local)
    found.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "changes-notes")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("path string, action string").parquet(out)


@query("snapshot_upsert", ("local_manifest", "remote_manifest", "stored"), """SELECT * FROM (SELECT path, name, size, modified, etag FROM local_manifest WHERE path NOT IN (SELECT path FROM remote_manifest WHERE starts_with(path, '/r4/'))
UNION ALL SELECT path, name, size, modified, etag FROM remote_manifest WHERE starts_with(path, '/r4/')) WHERE NOT (starts_with(path, '/r12/') AND path NOT IN (SELECT path FROM stored))""")
def snapshot_upsert(local, remote, stored):
    """K1, K2: the local manifest as a first version, one root's remote rows over it, another root's missing files out of it."""
    spark = local.sparkSession
    root = scratch(spark, "manifest")
    snapshots.commit(spark, root, local)
    snapshots.commit(spark, root, remote.where(F.col("path").startswith("/r4/")))
    snapshots.commit(spark, root, deletes=diff.purge(local.where(F.col("path").startswith("/r12/")), stored))
    return read_manifest(spark, root).drop("root")


@query("snapshot_download_plan", ("remote_manifest", "local_manifest", "selected_roots"), """, r AS (SELECT * FROM remote_manifest WHERE split_part(path, '/', 2) IN (SELECT root FROM selected_roots)),
l AS (SELECT * FROM local_manifest WHERE split_part(path, '/', 2) IN (SELECT root FROM selected_roots))
SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.modified > o.modified AND (n.size <> o.size OR n.etag <> o.etag) THEN 'changed' ELSE 'same' END AS action FROM r n LEFT JOIN l o ON n.path = o.path
UNION ALL SELECT path, 'delete' FROM l WHERE path NOT IN (SELECT path FROM r)""")
def snapshot_download_plan(remote, local, roots):
    """E1 over the local manifest's snapshot, of which the selected roots' partitions alone are read."""
    spark = local.sparkSession
    root = scratch(spark, "manifest")
    snapshots.commit(spark, root, local)
    return jobs.download_plan(remote, read_manifest(spark, root), roots=roots, snapshot=True)


@query("stream_reconcile", ("remote_manifest", "local_manifest"), f"""SELECT 1 AS batch, path, action FROM ({_CHANGES})
UNION ALL SELECT 2, path, 'same' FROM remote_manifest UNION ALL SELECT 0, path, 'new' FROM local_manifest""")
def stream_reconcile(remote, local):
    """T3 against the live manifest: the local rows arrive, then the remote ones, then these again."""
    spark = remote.sparkSession
    root, out, notes = scratch(spark, "manifest"), scratch(spark, "actions"), scratch(spark, "reconcile-notes")
    remote = remote.select(local.columns)
    _arrive([local, remote, remote], lambda arrived: streams.stream_reconcile(arrived, root, out, notes))
    return spark.read.schema("path string, action string, batch int").parquet(out)


#: Arrivals that the probes are replayed in.
REPLAYS = 3


def _by_time(probes):
    """The probes in REPLAYS frames, one after the other in time, and a row of no mirror so late that the watermark closes all windows of a day."""
    at = F.col("ts").cast("timestamp")
    seconds = F.unix_seconds(at)
    cuts, last = probes.agg(F.percentile_approx(seconds, [k / REPLAYS for k in range(1, REPLAYS)]), F.max(seconds)).first()
    if last is None:
        return [probes]
    edges = [None, *sorted(set(cuts)), None]
    frames = [probes.where((F.lit(True) if a is None else seconds > a) & (F.lit(True) if b is None else seconds <= b)) for a, b in zip(edges, edges[1:])]
    late = probes.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.timestamp_seconds(F.lit(last + 3 * 86400)).cast(f.dataType).alias("ts") for f in probes.schema))
    return [*frames, late]


@query("stream_mirror_health", ("mirror_probes",))
def stream_mirror_health(probes):
    """The probes arrive in time order; windows that the watermark has closed, in the end all, as batches publish them."""
    spark = probes.sparkSession
    out, notes = scratch(spark, "health"), scratch(spark, "health-notes")
    publish = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    _arrive(_by_time(probes), lambda arrived: streams.stream_mirror_health(arrived, publish, notes, "1 day"))
    return spark.read.schema("start timestamp, mirror string, n long, ok_count long, avg_ns long").parquet(out)


@query("stream_mirror_health_epochs", ("mirror_probes",), _HEALTH_BY_DAY)
def stream_mirror_health_epochs(probes):
    """T1 with the windows' starts in seconds, as mirror_health_window gives them."""
    return stream_mirror_health(probes).select(F.unix_timestamp("start").alias("start"), "mirror", "n", "ok_count", "avg_ns")
