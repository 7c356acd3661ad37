"""Columns that are worked out once for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """The table with the named columns as values, at its end. Spark moves a filter below the columns it reads and then works out
    their expressions once for each time the filter names them; it never moves one below a generator, here of one row."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
