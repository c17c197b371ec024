"""Inputs of the queries, derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DIR = "concat('/r', CAST((doc_id - doc_id % 4) % 44 AS STRING), '/t', CAST((doc_id - doc_id % 4) AS STRING))"
_FILE = "concat('d', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.strm' WHEN 1 THEN '.nfo' WHEN 2 THEN '.jpg' ELSE '.srt' END)"
_PATH = f"concat({_DIR}, '/', {_FILE})"
_FAILS = "(doc_id - doc_id % 4) % 44 = 8"

VIEWS = {
    "remote_manifest": f"SELECT {_PATH} AS path, {_FILE} AS name, n_chars AS size, 1704067200 + doc_id * 60 AS modified, md5(text) AS etag FROM documents",
    "local_manifest": f"""SELECT {_PATH} AS path, {_FILE} AS name, n_chars - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size,
        1704067200 + doc_id * 60 - CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 60 END AS modified, CASE WHEN doc_id % 11 = 0 THEN md5(lang) ELSE md5(text) END AS etag FROM documents WHERE doc_id % 5 <> 0
        UNION ALL SELECT concat('/r0/stale/d', CAST(doc_id AS STRING), '.nfo'), concat('d', CAST(doc_id AS STRING), '.nfo'), CAST(1 AS BIGINT), CAST(0 AS BIGINT), '' FROM labels WHERE toxic = 1""",
    "pointer_files": f"""SELECT concat({_DIR}, '/d', CAST(doc_id AS STRING), '.strm') AS path,
        concat('http://origin.local:5678/d/media%20lib', {_DIR}, '/d', CAST(doc_id AS STRING), '.mp4', chr(10)) AS content FROM documents WHERE doc_id % 4 = 0 AND doc_id % 20 <> 16""",
    "catalog_entries": f"SELECT concat('/media lib', {_DIR}) AS dir, concat('d', CAST(doc_id AS STRING), '.mp4') AS name, n_chars AS size, false AS is_dir FROM documents WHERE doc_id % 4 = 0 AND doc_id % 12 <> 0 AND NOT {_FAILS}",
    "catalog_dirs": f"SELECT DISTINCT concat('/media lib', {_DIR}) AS dir, CASE WHEN {_FAILS} THEN 500 ELSE 200 END AS code FROM documents WHERE doc_id % 4 = 0",
    "mirror_probes": "SELECT concat('m', CAST(user_id % 19 AS STRING)) AS mirror, ts, event_type <> 'error' AS ok, CAST(round(value * 1000000) AS BIGINT) AS ns FROM events",
    "header_responses": f"""SELECT {_PATH} AS path, CASE WHEN doc_id % 13 = 0 THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END AS content_type,
        CASE WHEN doc_id % 17 = 0 THEN '' ELSE CAST(n_chars AS STRING) END AS content_length,
        CASE WHEN doc_id % 19 = 0 THEN '' ELSE concat('Mon, ', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), ' Jan 2024 00:00:00 GMT') END AS last_modified, md5(text) AS etag FROM documents""",
    "mirror_attempts": f"""SELECT {_PATH} AS path, r_regionkey AS rank, concat('m', CAST(r_regionkey AS STRING)) AS mirror,
        CASE (doc_id * 3 + r_regionkey * 5) % 11 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 ELSE 500 END AS status FROM documents CROSS JOIN region""",
    "retry_log": "SELECT path, rank AS round, status FROM mirror_attempts",
    "catalog_pages": f"""SELECT concat('/media lib', {_DIR}) AS dir, 1 AS page, CASE WHEN {_FAILS} THEN '{{"code":500,"message":"object not found","data":null}}'
        ELSE concat('{{"code":200,"message":"success","data":{{"content":[{{"name":"d', CAST(doc_id AS STRING), '.mp4","size":', CAST(n_chars AS STRING), ',"is_dir":false,"modified":"2024-01-02T03:04:05.123456+08:00","type":2}},{{"name":"extras","size":0,"is_dir":true,"modified":"2024-01-02T00:00:00Z","type":1}}],"provider":"x","readme":"","total":', CASE WHEN doc_id % 16 = 0 THEN '3' ELSE '2' END, ',"write":false}}}}') END AS body FROM documents WHERE doc_id % 4 = 0""",
    "stat_responses": f"""SELECT {_PATH} AS path, CASE WHEN doc_id % 6 = 0 THEN '{{"code":500,"message":"object not found","data":null}}'
        ELSE concat('{{"code":200,"message":"success","data":{{"is_dir":false,"modified":"2024-01-02T03:04:05Z","name":"', {_FILE}, '","provider":"x","raw_url":"","readme":"","size":', CAST(n_chars AS STRING), ',"type":2}}}}') END AS body FROM documents""",
    "index_pages": f"""SELECT {_DIR} AS path, concat('http://origin.local', {_DIR}, '/') AS url,
        concat('<html><body><a href="../">Up</a><a href="?C=N">Name</a><a href="d', CAST(doc_id AS STRING), '.nfo">a</a><a class="x" href="/other/d', CAST(doc_id AS STRING), '.jpg">b</a><a href="extras', CAST(doc_id % 3 AS STRING), '/">c</a><!-- <a href="hidden.txt">no</a> --><a name="anchor">d</a></body></html>') AS html FROM documents WHERE doc_id % 4 = 0""",
    "typed_pages": "SELECT page_id, url, html, CASE WHEN page_id % 5 = 0 THEN 'application/json' WHEN page_id % 5 = 1 THEN 'text/html' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages",
    "mirror_responses": """SELECT concat('m', CAST(user_id % 19 AS STRING)) AS mirror, ts, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
        CASE WHEN user_id % 7 = 0 THEN 'down for maintenance' ELSE '<a href="films/">films</a>' END AS body, CAST(round(value * 1000000) AS BIGINT) AS ns FROM events""",
    "mirror_ranks": "SELECT concat('m', CAST(r_regionkey AS STRING)) AS mirror, 4 - r_regionkey AS rank FROM region",
    "mixed_pointers": "SELECT path, CASE WHEN length(path) % 3 = 0 THEN replace(content, 'origin.local', 'other.local') ELSE content END AS content FROM pointer_files",
    "tree": f"SELECT path FROM remote_manifest UNION SELECT concat('/r', CAST((doc_id - doc_id % 4) % 44 AS STRING)) AS path FROM documents UNION SELECT {_DIR} AS path FROM documents",
    "target_prefixes": "SELECT concat('/media lib', prefix) AS prefix FROM skip_prefixes",
    "skip_prefixes":"SELECT '/r4/' AS prefix UNION ALL SELECT '/r12/t12/'",
    "skip_lines": "SELECT CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' / ' WHEN 2 THEN concat(' ', source, '/x ') WHEN 3 THEN concat('/', source, '/') ELSE concat('/', source) END AS line FROM documents",
    "selected_roots": "SELECT 'r0' AS root UNION ALL SELECT 'r4' UNION ALL SELECT 'r12'",
    "odd_pages": f"""SELECT {_DIR} AS path, concat('http://origin.local', {_DIR}, '/') AS url,
        concat('<a data-href="wrong" href="right', CAST(doc_id AS STRING), '.txt">1</a><a title="a > b" href=bare', CAST(doc_id AS STRING), '.txt>2</a><A HREF = ''&#99;ode', CAST(doc_id AS STRING), '.txt''>3</A>',
        '<a href="caf&eacute;', CAST(doc_id AS STRING), '/">4</a><script>"<a href=no.txt>"</script><!-- <a href="no.txt"> --><textarea><a href=no.txt></textarea><abbr href=no.txt><p title="<a href=no.txt>"><a href="open', CAST(doc_id AS STRING)) AS html FROM documents WHERE doc_id % 4 = 0""",
    "page_sets": """SELECT concat('/lib/', CAST(doc_id - doc_id % 12 AS STRING)) AS dir, 1 + doc_id % 12 AS page, concat('{"code":200,"message":"success","data":{"content":[{"name":"d', CAST(doc_id - CASE WHEN doc_id % 36 = 9 THEN 1 ELSE 0 END AS STRING),
        '.mp4","size":1,"is_dir":false,"modified":"2024-01-02T00:00:00Z","type":2}],"provider":"x","readme":"","total":12,"write":false}}') AS body FROM documents WHERE doc_id % 60 <> 31
        UNION ALL SELECT concat('/lib/', CAST(doc_id - doc_id % 12 AS STRING)), 1 + doc_id % 12, concat('{"code":200,"message":"success","data":{"content":[{"name":"d', CAST(doc_id - CASE WHEN doc_id % 36 = 9 THEN 1 ELSE 0 END AS STRING),
        '.mp4","size":1,"is_dir":false,"modified":"2024-01-02T00:00:00Z","type":2}],"provider":"x","readme":"","total":12,"write":false}}') FROM documents WHERE doc_id % 5 = 0 AND doc_id % 60 <> 31""",
    "failed_dirs": "SELECT '/r0/stale' AS path UNION ALL SELECT '/r4/' UNION ALL SELECT '/nowhere'",
    "stored": f"SELECT {_PATH} AS path FROM documents WHERE doc_id % 9 <> 0",
}
_TABLES = ("documents", "labels", "events", "region", "pages")


def sql(view: str) -> str:
    """A view's SQL on the given tables only."""
    text = VIEWS[view]
    return re.sub(r"\bFROM (\w+)", lambda m: f"FROM ({sql(m[1])}) AS {m[1]}" if m[1] in VIEWS else m[0], text)


def with_views(*views: str) -> str:
    """The start of a DuckDB query that reads the views."""
    return "WITH " + ",\n".join(f"{v} AS ({sql(v)})" for v in views) + "\n"


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    names = "|".join(_TABLES)
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({names})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql(view)))
