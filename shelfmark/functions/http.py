"""Header, time and listing line expressions: P6-P10, P18."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the year 1, what a missing or invalid date counts as.
ZERO_TIME = -62135596800


def media_type(content_type: Column) -> Column:
    """Without parameters."""
    return F.when(F.contains(content_type, F.lit(";")), F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).otherwise(content_type)


def content_length(text: Column) -> Column:
    """0 if it isn't a whole number."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")), F.lit(0).cast("long"))


def http_date_epoch(text: Column) -> Column:
    """RFC 1123 to epoch seconds, the zero time if it doesn't parse. The session's time zone must be UTC."""
    own = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) [A-Z]+\z", 1)
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(own, F.lit("dd MMM yyyy HH:mm:ss"))), F.lit(ZERO_TIME))


def mod_time(modified: Column) -> Column:
    """P9."""
    return F.timestamp_seconds(modified)


def rfc3339_nano(ts: Column) -> Column:
    """P10: ISO text in UTC without trailing zeros of the fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+\z", "")
    return F.concat(whole, part, F.date_format(ts, "XXX"))


def listing_line(df: DataFrame) -> DataFrame:
    """(path, is_dir) -> line with mode and path."""
    return df.select(F.concat(F.when(F.col("is_dir"), "drwxr-xr-x").otherwise("-rw-r--r--"), F.lit("\t"), "path").alias("line"))
