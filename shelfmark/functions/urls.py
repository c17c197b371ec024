"""URL expressions: P5, P11-P15, P17, P19."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, clean_path

#: Characters that stay as they are in an encoded path, as url_encode writes them.
_LITERAL = {"+": "%20", "%7E": "~", "%2F": "/", "%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@", "*": "%2A"}


def encode_uri_path(path: Column) -> Column:
    """Percent-encoding of a path."""
    out = F.url_encode(path)
    for a, b in _LITERAL.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode_uri_path(uri: Column) -> Column:
    """Cut at the first `?` and decoded; the text as it is where that doesn't parse."""
    plain = F.try_url_decode(F.replace(F.split_part(uri, F.lit("?"), F.lit(1)), F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.when(~uri.rlike(r"[\x00-\x1F\x7F]"), plain), uri)


def pointer_text(content: Column) -> Column:
    """Trimmed of all Unicode white space, `%20` as blanks."""
    return F.replace(F.regexp_replace(content, r"(?U)^\s+|\s+\z", ""), F.lit("%20"), F.lit(" "))


def _below(text: Column, prefix: str) -> Column:
    rest = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    return F.concat(F.lit("/"), F.regexp_replace(rest, "^/", ""))


def strip_endpoint(text: Column, endpoint: str) -> Column:
    """The path after a known endpoint; null for other URLs."""
    return F.when(text.startswith(endpoint), _below(text, endpoint))


def strip_root(path: Column, root: str = "/d", strict: bool = False) -> Column:
    """Without the stream root. As in the original there is no boundary check (`/data` -> `/ata`) unless strict."""
    if strict:
        return F.when((path == root) | path.startswith(root + "/"), _below(path, root)).otherwise(path)
    return _below(path, root)


def pointer_target(content: Column, endpoint: str, root: str = "/d", strict: bool = False) -> Column:
    """The catalog path that a pointer leads to; null if it leads elsewhere."""
    return decode_uri_path(strip_root(strip_endpoint(pointer_text(content), endpoint), root, strict))


def rewrite_pointer(content: Column, old_endpoint: str, new_endpoint: str, new_root: str, root: str = "/d") -> Column:
    """The pointer's URL on the new endpoint; other URLs pass as pointer_text leaves them."""
    text = pointer_text(content)
    inner = strip_root(strip_endpoint(text, old_endpoint), root)
    target = decode_uri_path(F.concat(F.lit("/" + new_root.removeprefix("/") + "/"), F.regexp_replace(inner, "^/", "")))
    return F.coalesce(F.concat(F.lit(new_endpoint.rstrip("/")), encode_uri_path(target)), text)


def endpoint_valid(url: Column) -> Column:
    """An http(s) URL whose path is the root."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(url.rlike(r"^https?://[^/?#]+"), F.lit(False)) & F.coalesce(path, F.lit("x")).isin("", "/")


def url_path(url: Column) -> Column:
    """The path of an absolute http(s) URL as it is written."""
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def fetch_url(mirror: Column, path: Column) -> Column:
    """Mirror and path joined."""
    return F.concat(F.regexp_replace(mirror, r"/+\z", ""), encode_uri_path(clean_path(path)))


def link_path(base: Column, href: Column) -> Column:
    """P5: where a link leads, seen from a page at path `base`: written path, not decoded; null for other schemes."""
    own = F.regexp_extract(href, "^([^?#]*)", 1)
    folder = F.when(base.endswith("/"), base).otherwise(F.regexp_replace(base, r"[^/]*\z", ""))
    return (
        F.when(href.rlike("(?i)^https?://"), url_path(href))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.regexp_extract(href, "^//[^/?#]*([^?#]*)", 1))
        .when(own == "", base)
        .when(own.startswith("/"), own)
        .otherwise(F.concat(folder, own))
    )


def resolve_link(base: Column, href: Column) -> Column:
    """P5: the decoded, cleaned path of a link's target."""
    return clean_path(decode_uri_path(link_path(base, href)))


def link_kind(written: Column) -> Column:
    """`dir` if it ends in a slash, null for `.` and `..`, else `file`."""
    return F.when(written.endswith("/"), "dir").when(basename(written).isin(".", ".."), None).otherwise("file")
