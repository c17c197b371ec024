"""Captured responses as rows: S5-S8, A9, F7, F8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import anchors, references, written
from ..functions.http import content_length, http_date_epoch, media_type
from ..functions.paths import basename, clean_path
from ..functions.urls import decode_uri_path, link_kind, link_path, resolve_link, url_path
from ..schemas import GET_RESPONSE, LIST_RESPONSE

HTML = "text/html"
HTML_DIR_SIZE = 128


def extract_links(pages: DataFrame, same_host_only: bool = False) -> DataFrame:
    """Pages (url, html, any more) -> their columns but html, and path, name, is_dir of each child link.

    Links to the page itself or above it are no children. As in the original, whatever else a link
    leads to becomes a direct child by its last element (unless same_host_only). Pages that come with a
    content_type are listings only if that is HTML. The pages' other columns keep any name.
    """
    if "content_type" in pages.columns:
        pages = only_html(pages)
    keep = [c for c in pages.columns if c not in ("html", "path", "name", "is_dir")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "url", F.explode(F.filter(F.transform(anchors(F.col("html")), lambda tag: written(tag, "href")), lambda x: x.isNotNull())).alias("raw"))
    rows = rows.withColumn("href", references(F.col("raw")))
    page = F.when(url_path(F.col("url")) == "", "/").otherwise(url_path(F.col("url")))
    if same_host_only:
        host = r"(?i)^https?://([^/?#]+)"
        rows = rows.where(~F.col("href").rlike(host) | (F.regexp_extract("href", host, 1) == F.regexp_extract("url", host, 1)))
    rows = rows.withColumn("written", link_path(page, F.col("href"))).withColumn("kind", link_kind(F.col("written"))).where("kind IS NOT NULL")
    rows = rows.withColumn("base", clean_path(decode_uri_path(page))).withColumn("target", resolve_link(page, F.col("href")))
    above = (F.col("target") == F.col("base")) | (F.col("target") == "/") | F.startswith("base", F.concat("target", F.lit("/")))
    rows = rows.where(~above).withColumn("name", basename(F.col("target")))
    child = F.concat(F.when(F.col("base") == "/", "").otherwise(F.col("base")), F.lit("/"), "name")
    return rows.select("row.*", child.alias("path"), "name", (F.col("kind") == "dir").alias("is_dir"))


def drop_html(responses: DataFrame) -> DataFrame:
    """HTML bodies are no files."""
    return responses.where(F.coalesce(media_type(F.col("content_type")), F.lit("")) != HTML)


def only_html(pages: DataFrame) -> DataFrame:
    """F8: a listing that isn't HTML is empty."""
    return pages.where(media_type(F.col("content_type")) == HTML)


def files_from_headers(responses: DataFrame) -> DataFrame:
    """Header records -> LISTING rows; HTML is a directory of a fixed size."""
    is_dir = F.coalesce(media_type(F.col("content_type")) == HTML, F.lit(False))
    return responses.select(
        "path",
        basename(F.col("path")).alias("name"),
        F.when(is_dir, F.lit(HTML_DIR_SIZE).cast("long")).otherwise(content_length(F.col("content_length"))).alias("size"),
        http_date_epoch(F.col("last_modified")).alias("modified"),
        "etag",
        is_dir.alias("is_dir"),
    )


def _parsed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("r", F.from_json("body", LIST_RESPONSE))


def page_set(pages: DataFrame) -> DataFrame:
    """Pages (dir, page, body, any more) -> one capture of each page: the latest if there is a `captured` column
    that says when, else the one whose body sorts last."""
    return latest_by(pages, ["dir", "page"], ["captured", "body"] if "captured" in pages.columns else ["body"])


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [*order, *(c for c in rows.columns if c not in (*keys, *order))]
    return rows.groupBy(*keys).agg(F.max(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_row")).select(*keys, "_row.*").select(*(F.col(f"`{c}`") for c in rows.columns))


def catalog_entries(pages: DataFrame) -> DataFrame:
    """Pages (dir, page, body) -> CATALOG_ENTRY rows of all pages, of pages captured more than once of one capture."""
    rows = _parsed(page_set(pages)).select("dir", F.explode("r.data.content").alias("e"))
    return rows.select("dir", "e.name", "e.size", "e.modified", "e.is_dir")


def catalog_dirs(pages: DataFrame) -> DataFrame:
    """Status of each listed directory: null data is not found, whatever the code."""
    rows = _parsed(page_set(pages)).groupBy("dir").agg(F.bool_and(F.col("r.data").isNotNull()).alias("listed"), F.max("r.code").alias("code"))
    return rows.select("dir", F.when(F.col("listed"), F.col("code")).otherwise(404).alias("code"))


def _received(pages: DataFrame) -> DataFrame:
    """(dir, listed, code, complete): complete if the pages from 1 on have no gap and hold as many different names as
    the last page announces."""
    one = _parsed(page_set(pages)).withColumn("listed", F.col("r.data").isNotNull())
    heads = one.groupBy("dir").agg(
        F.bool_and("listed").alias("listed"),
        F.max("r.code").alias("code"),
        F.max_by("r.data.total", "page").alias("total"),
        ((F.min("page") == 1) & (F.max("page") == F.count("*"))).alias("whole"),
    )
    names = one.select("dir", F.explode("r.data.content.name").alias("name")).distinct().groupBy("dir").agg(F.count("*").alias("n"))
    rows = heads.join(names, "dir", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("dir", "listed", "code", F.when(F.col("total").isNotNull(), F.col("whole") & (F.col("n") >= F.col("total"))).alias("complete"))


def listing_status(pages: DataFrame) -> DataFrame:
    """A9 for J5: status of each directory as catalog_dirs gives it, but 206 if rows that its listing announces are
    missing, or a page between others is: what isn't in an incomplete listing can't be called absent."""
    return _received(pages).select("dir", F.when(~F.col("listed"), 404).when(~F.col("complete"), 206).otherwise(F.col("code")).alias("code"))


def catalog_stat(responses: DataFrame) -> DataFrame:
    """(path, body) -> the entry and its state."""
    rows = responses.withColumn("r", F.from_json("body", GET_RESPONSE))
    return rows.select("path", F.col("r.data.name").alias("name"), F.col("r.data.size").alias("size"), F.col("r.data.modified").alias("modified"), F.col("r.data.is_dir").alias("is_dir"), F.when(F.col("r.data").isNull(), "not_found").otherwise("found").alias("state"))


def listing_complete(pages: DataFrame) -> DataFrame:
    """Whether all pages and rows that a listing announces were received; null data is null."""
    return _received(pages).select("dir", "complete")
