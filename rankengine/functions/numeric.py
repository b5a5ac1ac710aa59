"""Rounding of doubles in binary, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, digits: int) -> Column:
    """Unlike F.round, which rounds the decimal rendering, this scales in binary first."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double") / scale
