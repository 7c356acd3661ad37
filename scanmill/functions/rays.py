"""Geometry of one ray from a start point through an end point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def _minus(a: Triple, b: Triple) -> Triple:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def _dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Triple) -> Column:
    return F.sqrt(_dot(a, a))


def end_point(start: Triple, distance: Column, azimuth: Column, elevation: Column) -> Triple:
    """Point ``distance`` away from the start; angles in radians."""
    flat = distance * F.cos(elevation)
    return (
        start[0] + flat * F.cos(azimuth),
        start[1] + flat * F.sin(azimuth),
        start[2] + distance * F.sin(elevation),
    )


def ray_parameter(start: Triple, direction: Triple, length_squared: Column, point: Triple) -> Column:
    """Position of the point's foot on the ray: 0 at the start, 1 at the end."""
    return _dot(_minus(point, start), direction) / length_squared


def ray_offset(start: Triple, direction: Triple, point: Triple, t: Column) -> Column:
    """Distance between the point and its foot on the ray."""
    return norm(tuple(point[i] - (start[i] + t * direction[i]) for i in range(3)))


def onto_ray(start: Triple, direction: Triple, point: Triple) -> Triple:
    """The point of the ray that is as far from the start as ``point`` is."""
    length = norm(direction)
    scale = norm(_minus(point, start)) / F.when(length > 0, length).otherwise(
        F.raise_error(F.lit("a ray needs two distinct points")).cast("double")
    )
    return tuple(start[i] + scale * direction[i] for i in range(3))
