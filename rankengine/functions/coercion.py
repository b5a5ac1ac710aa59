"""Payload values as columns: numbers in strings, durations, times in two notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_int(x: Column) -> Column:
    """An integer, also as a string; absent: 0."""
    return F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))


def as_seconds(x: Column) -> Column:
    """'198.030s' or a plain number; absent or empty: null."""
    return F.regexp_replace(x, "s$", "").try_cast("double")


def as_epoch(x: Column) -> Column:
    """RFC 3339 or unix seconds; absent or empty: null."""
    return F.coalesce(x.try_cast("bigint"), F.unix_timestamp(x.try_cast("timestamp")))


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")
