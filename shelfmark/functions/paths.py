"""Path expressions: P1-P5, P16 and the walk order key of O2."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` elements."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def dirname(path: Column) -> Column:
    """What stands before the last slash, `/` for top entries."""
    found = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(found == "", "/").otherwise(found)


def basename(path: Column) -> Column:
    """The last element."""
    return F.element_at(F.split(path, "/"), -1)


def ext(path: Column) -> Column:
    """From the last dot of the last element on; upper and lower case differ."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def elements(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def root_of(path: Column, scan_dir: str = "") -> Column:
    """The first element below scan_dir, '' if there is none."""
    below = F.when(path.startswith(scan_dir), F.substr(path, F.lit(len(scan_dir) + 1))).otherwise(path) if scan_dir else path
    return F.coalesce(F.get(elements(below), F.lit(0)), F.lit(""))


#: The partition of files that stand directly under `/`; no clean path has an element of this name.
TOP = "."


def partition_of(path: Column) -> Column:
    """The snapshot partition of a path: its first element, or TOP if that is all of it."""
    return F.when(F.size(elements(path)) > 1, root_of(path)).otherwise(TOP)


def ancestors(path: Column) -> Column:
    """All proper ancestors with a slash at the end, from the root on: the prefixes that a skip list may hold."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))


def normalise_prefix(prefix: Column) -> Column:
    """Trimmed, one slash at both ends; null for blank lines and `/`, which are no prefixes."""
    text = F.trim(prefix)
    framed = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(text, "^/", ""), r"/\z", ""), F.lit("/"))
    return F.when((text != "") & (text != "/"), framed)


def walk_key(path: Column) -> Column:
    """O2: arrays of elements sort as a pre-order walk does, children bytewise by name."""
    return F.when(path == "/", F.array(F.lit(""))).otherwise(F.split(path, "/"))
