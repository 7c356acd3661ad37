"""Oriented boxes: corner points, containment, class names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanmill.config import BOX_COLOURS, CLASS_IDS, CLASS_NAMES, OTHER_CLASS
from scanmill.functions.angles import rotate_xy

ROTATIONS = ("inverse_yaw", "forward_yaw", "pinned")


def into_box_frame(
    x: Column, y: Column, z: Column, heading: Column, rotation: str = "inverse_yaw"
) -> tuple[Column, Column, Column]:
    """Offset from a box centre in the box's own axes.

    ``inverse_yaw`` undoes the heading, which is what the geometry asks for.
    ``forward_yaw`` applies it once more and ``pinned`` turns y and z about x instead;
    both exist to reproduce label sets that were cut that way.
    """
    if rotation == "inverse_yaw":
        return *rotate_xy(-heading, x, y), z
    if rotation == "forward_yaw":
        return *rotate_xy(heading, x, y), z
    if rotation == "pinned":
        return x, *rotate_xy(heading, y, z)
    raise ValueError(f"unknown box rotation {rotation!r}; expected one of {ROTATIONS}")


def inside_box(local: tuple[Column, Column, Column], dims: tuple[Column, Column, Column]) -> Column:
    """Bounds are inclusive on all three axes."""
    ok = [(v >= -d / 2) & (v <= d / 2) for v, d in zip(local, dims)]
    return ok[0] & ok[1] & ok[2]


def box_corners(
    x: Column, y: Column, length: Column, width: Column, heading: Column
) -> list[tuple[Column, Column]]:
    """Ground corners: front left, rear left, rear right, front right."""
    corners, c, s = [], F.cos(heading), F.sin(heading)
    for along, across in ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5)):
        # Along first, then across, so that the last bit is the same wherever corners are compared.
        ahead, aside = length * along, width * across
        corners.append((x + c * ahead - s * aside, y + s * ahead + c * aside))
    return corners


def corners_by_angle(corners: Column) -> Column:
    """Corner structs ``(x, y)`` ordered by their angle around the mean point."""
    return F.transform(corner_angles(corners), lambda k: k["p"])


def corner_angles(corners: Column) -> Column:
    """Structs of the angle around the mean point, the corner's number and the corner ``p``, by angle."""
    n = F.size(corners)
    mean_x = F.aggregate(corners, F.lit(0.0), lambda a, p: a + p["x"]) / n
    mean_y = F.aggregate(corners, F.lit(0.0), lambda a, p: a + p["y"]) / n
    keyed = F.transform(
        corners,
        lambda p, i: F.struct(
            F.atan2(p["y"] - mean_y, p["x"] - mean_x).alias("angle"), i.alias("i"), p.alias("p")
        ),
    )
    return F.array_sort(keyed)


def _lookup(key: Column, table: dict, convert=F.lit) -> Column:
    out = None
    for value, result in table.items():
        out = F.when(key == value, convert(result)) if out is None else out.when(key == value, convert(result))
    return out


def class_name(box_type: Column) -> Column:
    return F.coalesce(_lookup(box_type, CLASS_NAMES), F.lit(OTHER_CLASS))


def class_id(name: Column) -> Column:
    """Class number, or null for any other name."""
    return _lookup(name, CLASS_IDS)


def box_colour(box_type: Column) -> Column:
    """RGB in [0, 1], or null for a type that is not kept."""
    return _lookup(box_type, BOX_COLOURS, lambda rgb: F.array(*[F.lit(v) for v in rgb]))
