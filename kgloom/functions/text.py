"""Column functions for names, ids and labels (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(c: Column | str) -> Column:
    """Without surrounding white space of any Unicode kind; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")


def norm(c: Column | str) -> Column:
    """``strip_ws`` with null read as ''."""
    return F.coalesce(strip_ws(c), F.lit(""))


def blank(c: Column | str) -> Column:
    """True for null and for text of white space only."""
    return norm(c) == ""
