"""Small text helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_from_name(name: Column) -> Column:
    """Four-digit year at the end of a layer or file name such as ``damage_Year.2004.parquet``."""
    found = F.regexp_extract(name, r"Year[.=]([0-9]{4})", 1)
    return F.when(found != "", found.cast("int"))


def strip_prefix(v: Column, prefix: str) -> Column:
    """Drop a leading word followed by a blank or a dot (``observed triploid`` -> ``triploid``)."""
    return F.regexp_replace(v, rf"^{prefix}[ .]", "")


def band_number(name: Column, prefix: str) -> Column:
    """Number behind a band name such as ``W645.2``; NULL when there is none."""
    return F.regexp_replace(name, prefix, "").try_cast("double")
