"""Voxel indices and the integer walk of a ray through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_PRECISIONS = ("double", "float")


def voxel_index(value: Column, size: float, precision: str = "double") -> Column:
    """Index of the cell that holds a coordinate.

    ``float`` divides in single precision, for results equal to a single-precision grid:
    the quotient of two singles, taken in double and rounded once, is the single quotient.
    """
    if precision == "double":
        return F.floor(value.cast("double") / F.lit(size)).cast("int")
    if precision == "float":
        quotient = value.cast("float").cast("double") / F.lit(size).cast("float").cast("double")
        return F.floor(quotient.cast("float")).cast("int")
    raise ValueError(f"unknown grid precision {precision!r}; expected one of {GRID_PRECISIONS}")


def minor_offset(minor: Column, major: Column, step: Column) -> Column:
    """Unsigned offset on a minor axis after ``step`` cells along the driving axis.

    The integer walk rounds ``minor * step / major`` half up; all arguments are non-negative.
    """
    numerator = 2 * minor.cast("long") * step + major
    return F.floor(numerator / (2 * major)).cast("long")


def walk_length(dx: Column, dy: Column, dz: Column) -> Column:
    """Number of cells a ray visits: the largest of the three unsigned index deltas."""
    return F.greatest(F.abs(dx), F.abs(dy), F.abs(dz))


def driving_axis(dx: Column, dy: Column, dz: Column) -> Column:
    """0, 1 or 2: the axis with the largest delta; x wins ties, then y."""
    ax, ay, az = F.abs(dx), F.abs(dy), F.abs(dz)
    return F.when((ax >= ay) & (ax >= az), 0).when((ay >= ax) & (ay >= az), 1).otherwise(2)


def walk_cell(delta: Column, length: Column, step: Column) -> Column:
    """Signed index offset on one axis after ``step`` cells (driving or minor alike)."""
    return (F.signum(delta) * minor_offset(F.abs(delta), length, step)).cast("int")


def walk_steps(length: Column) -> Column:
    """``1 .. length`` as an array; empty for a ray that stays in its first cell."""
    return F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
