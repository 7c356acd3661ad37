"""Rounding that stays in generated double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column, places: int) -> Column:
    """The value on a decimal grid, so that a comparison does not hang on the last bit of a
    platform's sine and cosine. The built-in round goes through decimals and is far slower."""
    scale = float(10**places)
    return F.rint(value * scale) / F.lit(scale)
