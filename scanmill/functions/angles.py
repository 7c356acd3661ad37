"""Angles and planar poses. A planar pose is a tuple of columns ``(x, y, yaw)``."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

PlanarPose = tuple[Column, Column, Column]


def angle_difference(a: Column, b: Column) -> Column:
    """``a - b`` brought into [-pi, pi)."""
    turn = a - b
    return turn - F.floor((turn + pi) / (2 * pi)) * (2 * pi)


def wrap_to_pi(angle: Column) -> Column:
    """The same range by floor-modulus."""
    return F.pmod(angle + pi, F.lit(2 * pi)) - pi


def rotate_xy(angle: Column, x: Column, y: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return x * c - y * s, x * s + y * c


def place_xy(pose: PlanarPose, x: Column, y: Column) -> tuple[Column, Column]:
    """Rotate by the pose's yaw, then shift by its position."""
    rx, ry = rotate_xy(pose[2], x, y)
    return pose[0] + rx, pose[1] + ry


def planar_difference(a: PlanarPose, b: PlanarPose) -> PlanarPose:
    """Pose ``a`` as seen from pose ``b``."""
    dx, dy = rotate_xy(-b[2], a[0] - b[0], a[1] - b[1])
    return dx, dy, angle_difference(a[2], b[2])


def bearing_offset_deg(dx: Column, dy: Column, yaw_deg: Column) -> Column:
    """Bearing of ``(dx, dy)`` relative to a yaw, in [-180, 180) degrees."""
    bearing = F.degrees(F.atan2(dy, dx))
    return F.pmod(bearing - yaw_deg + 180.0, F.lit(360.0)) - 180.0
