"""Path and label normalisation. ASCII keys stay in the JVM; case folding of other text needs Python once, at ingest."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NON_UTF8_PREFIX = "__NON_UTF8_RAW_BYTES__/"


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


def fold(c: Column, ascii_only: bool = False) -> Column:
    """NFC, then full case folding; ``ascii_only`` promises ASCII text and stays native."""
    return F.lower(c) if ascii_only else _fold(c)


def clean_path(c: Column) -> Column:
    """Separators unified; empty and '.' components and leading separators dropped; '..' stays."""
    parts = F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(parts, "/")


def normal_path(c: Column, ascii_only: bool = False) -> Column:
    return fold(clean_path(c), ascii_only)


def top_part(c: Column) -> Column:
    """First component; a leading '/' is a component of its own."""
    return F.when(c.startswith("/"), "/").otherwise(F.element_at(F.split(c, "/"), 1))


def last_part(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def below_top(c: Column) -> Column:
    """The path without its first component; null for a single component."""
    return F.when(F.instr(c, "/") > 0, F.regexp_extract(c, "^[^/]+/(.*)$", 1))


def volume_path(c: Column) -> tuple[Column, Column]:
    """(tape, relative path) of /Volumes/<tape>/<path>; null where the shape is another."""
    rx = r"(?s)^/Volumes/([^/]+)/(?:\./)*(.*)$"
    relative = F.array_join(F.filter(F.split(F.regexp_extract(c, rx, 2), "/"), lambda p: (p != "") & (p != ".")), "/")
    ok = c.rlike(rx) & (relative != "")
    return F.when(ok, F.regexp_extract(c, rx, 1)), F.when(ok, relative)


def cassette_label(c: Column, ascii_only: bool = False) -> Column:
    """Upper-cased and trimmed; a generation suffix L5 to L9 goes only from labels of the usual shape."""
    cleaned = F.regexp_replace(F.upper(F.trim(c)), r"^([A-Z]{2,5}[0-9]{3,7})L[5-9]$", "$1")
    return fold(cleaned, ascii_only)


def raw_display(raw: Column) -> Column:
    """Text of path bytes; bytes that are no UTF-8 are shown as \\xNN."""

    @F.pandas_udf(StringType())
    def show(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "backslashreplace"))

    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(show(raw))


def raw_key(raw: Column, ascii_only: bool = False) -> Column:
    """Key of path bytes: the normal path, or a hex key that no manifest path can equal."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), normal_path(text, ascii_only)).otherwise(F.concat(F.lit(NON_UTF8_PREFIX), F.lower(F.hex(raw))))


def sorted_join(values: Column) -> Column:
    """Aggregate: distinct values that are not empty, sorted, joined by ' | '."""
    return F.array_join(F.array_sort(F.collect_set(F.when(values != "", values))), " | ")
