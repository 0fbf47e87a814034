"""String expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(col: str | Column) -> Column:
    """A surface or operation name in lower case without outer blanks; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def root_path(col: str | Column) -> Column:
    """One spelling for a directory: back slashes turned, ``//`` and ``/./`` collapsed, no trailing slash."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"\\", "/")
    c = F.regexp_replace(c, r"/(\./)+", "/")
    c = F.regexp_replace(c, r"/(\./|/)+", "/")
    c = F.regexp_replace(c, r"/\.$", "/")
    return F.when(c == "/", c).otherwise(F.regexp_replace(c, r"/+$", ""))


def utc_day(col: str | Column) -> Column:
    """Days since the epoch of a timestamp without zone (or in a UTC session)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_date(F.to_date(c))
