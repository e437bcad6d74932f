"""Classification of stream addresses and names of stored files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and characters.
WEB_ADDRESS = r"(?i)^https?://"
SPACE_RUN = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
LAST_EXTENSION = r"^.+(\.[^.]*)$"


def camera_source_type(url: Column) -> Column:
    return F.when(url.rlike(WEB_ADDRESS), "http").otherwise("rtsp")


def _address(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", ""))


def stream_type(url: Column, strict: bool = False) -> Column:
    """``rtsp`` or ``http``; any other address is null, or fails the query when ``strict``."""
    address = _address(url)
    known = F.when(address.startswith("rtsp://"), "rtsp").when(address.rlike(r"^https?://"), "http")
    if strict:
        return known.otherwise(
            F.raise_error(F.concat(F.lit("Unsupported stream URL: "), F.coalesce(url, F.lit(""))))
        )
    return known


def is_replayable_file(source: Column) -> Column:
    address = _address(source)
    return ~(address.isin("", "0") | address.rlike(r"^(rtsp|https?)://"))


def stored_name(name: Column, millis: Column) -> Column:
    """``<millis>-<base><ext>``: the base lower-cased with spaces as dashes, the extension kept."""
    file_name = F.regexp_extract(name, r"([^/]*)/*$", 1)
    ext = F.regexp_extract(file_name, LAST_EXTENSION, 1)
    base = F.substring(file_name, F.lit(1), F.length(file_name) - F.length(ext))
    dashed = F.lower(F.regexp_replace(base, SPACE_RUN, "-"))
    return F.concat(millis.cast("string"), F.lit("-"), dashed, ext)
