"""Rigid motions as column expressions.

A pose is ``array<double>`` of 16, row-major. A motion is a plain dict with the
twelve columns ``r00 .. r22, t0, t1, t2``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanmill.functions.angles import PlanarPose, rotate_xy

Motion = dict[str, Column]
MOTION_FIELDS = tuple(f"r{i}{j}" for i in range(3) for j in range(3)) + ("t0", "t1", "t2")
POSE_CONVENTIONS = ("vehicle_to_world", "world_to_vehicle")


def motion_of(pose: Column) -> Motion:
    out = {f"r{i}{j}": pose[4 * i + j] for i in range(3) for j in range(3)}
    out.update({f"t{i}": pose[4 * i + 3] for i in range(3)})
    return out


def motion_columns(prefix: str = "") -> Motion:
    return {name: F.col(prefix + name) for name in MOTION_FIELDS}


def inverse(m: Motion) -> Motion:
    out = {f"r{i}{j}": m[f"r{j}{i}"] for i in range(3) for j in range(3)}
    for i in range(3):
        out[f"t{i}"] = -(m[f"r0{i}"] * m["t0"] + m[f"r1{i}"] * m["t1"] + m[f"r2{i}"] * m["t2"])
    return out


def compose(a: Motion, b: Motion) -> Motion:
    """First ``b``, then ``a``."""
    out = {
        f"r{i}{j}": a[f"r{i}0"] * b[f"r0{j}"] + a[f"r{i}1"] * b[f"r1{j}"] + a[f"r{i}2"] * b[f"r2{j}"]
        for i in range(3)
        for j in range(3)
    }
    for i in range(3):
        out[f"t{i}"] = a[f"r{i}0"] * b["t0"] + a[f"r{i}1"] * b["t1"] + a[f"r{i}2"] * b["t2"] + a[f"t{i}"]
    return out


def relative_motion(source: Motion, target: Motion, convention: str = "vehicle_to_world") -> Motion:
    """Motion that carries points of the source vehicle frame into the target vehicle frame.

    Source and target are the two frames' poses.
    """
    if convention == "vehicle_to_world":
        # The shift between the two positions is taken before it is turned: world
        # coordinates are large, their difference is not.
        shift = {**source, **{f"t{i}": source[f"t{i}"] - target[f"t{i}"] for i in range(3)}}
        still = {**target, **{f"t{i}": F.lit(0.0) for i in range(3)}}
        return compose(inverse(still), shift)
    if convention == "world_to_vehicle":
        return compose(target, inverse(source))
    raise ValueError(f"unknown pose convention {convention!r}; expected one of {POSE_CONVENTIONS}")


def rigid_pose(pose: Column, tolerance: float = 1e-3, frame: Column | None = None) -> Column:
    """The pose itself, or an error that names the ``frame`` when its rotation part has a determinant other than one."""
    m = motion_of(pose)
    det = (
        m["r00"] * (m["r11"] * m["r22"] - m["r12"] * m["r21"])
        - m["r01"] * (m["r10"] * m["r22"] - m["r12"] * m["r20"])
        + m["r02"] * (m["r10"] * m["r21"] - m["r11"] * m["r20"])
    )
    return F.when(F.abs(det - 1.0) <= tolerance, pose).otherwise(
        F.raise_error(F.concat(F.lit("pose is not a rigid motion: frame "), F.lit("?") if frame is None else frame)).cast("array<double>")
    )


def apply_motion(m: Motion, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(
        m[f"r{i}0"] * x + m[f"r{i}1"] * y + m[f"r{i}2"] * z + m[f"t{i}"] for i in range(3)
    )


def planar_of(m: Motion) -> PlanarPose:
    """Position and yaw in the plane; roll, pitch and z are dropped."""
    return m["t0"], m["t1"], motion_yaw(m)


def motion_yaw(m: Motion) -> Column:
    return F.atan2(m["r10"], m["r00"])


def rotation_from_rpy(roll: Column, pitch: Column, yaw: Column) -> Motion:
    """Rotation yaw after pitch after roll, with a zero shift."""
    cr, sr, cp, sp, cy, sy = (
        F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw),
    )
    return {
        "r00": cy * cp, "r01": cy * sp * sr - sy * cr, "r02": cy * sp * cr + sy * sr,
        "r10": sy * cp, "r11": sy * sp * sr + cy * cr, "r12": sy * sp * cr - cy * sr,
        "r20": -sp, "r21": cp * sr, "r22": cp * cr,
        "t0": F.lit(0.0), "t1": F.lit(0.0), "t2": F.lit(0.0),
    }


def to_sensor_xyz(
    x: Column, y: Column, z: Column, tx: Column, ty: Column, tz: Column, yaw: Column
) -> tuple[Column, Column, Column]:
    """Vehicle frame to the frame of a sensor shifted by ``t`` and turned by ``yaw`` radians."""
    xs, ys = rotate_xy(-yaw, x - tx, y - ty)
    return xs, ys, z - tz


def into_sensor(m: Motion, tx: Column, ty: Column, tz: Column, yaw: Column) -> Motion:
    """The motion followed by :func:`to_sensor_xyz`."""
    c, s = F.cos(yaw), F.sin(yaw)
    shifted = {**m, "t0": m["t0"] - tx, "t1": m["t1"] - ty, "t2": m["t2"] - tz}
    out = dict(shifted)
    for column in ("r00", "r01", "r02", "t0"):
        below = column.replace("r0", "r1") if column != "t0" else "t1"
        out[column] = c * shifted[column] + s * shifted[below]
        out[below] = c * shifted[below] - s * shifted[column]
    return out


def sensor_planar_motion(vehicle: PlanarPose, tx: Column, ty: Column, yaw: Column) -> PlanarPose:
    """A planar vehicle motion re-expressed for points in the frame of a mounted sensor.

    The lever arm ``(tx, ty)`` swings with the vehicle's turn; the turn itself is unchanged.
    """
    swing_x, swing_y = rotate_xy(vehicle[2], tx, ty)
    mx, my = rotate_xy(-yaw, vehicle[0] + swing_x - tx, vehicle[1] + swing_y - ty)
    return mx, my, vehicle[2]


def plane_to_sensor(
    a: Column, b: Column, c: Column, d: Column,
    tx: Column, ty: Column, tz: Column, yaw: Column,
    normalise: bool = True, face_up: bool = True,
) -> tuple[Column, Column, Column, Column]:
    """Plane ``a x + b y + c z + d = 0`` of the vehicle frame in sensor coordinates."""
    na, nb = rotate_xy(-yaw, a, b)
    plane = [na, nb, c, a * tx + b * ty + c * tz + d]
    if normalise:
        length = F.sqrt(a * a + b * b + c * c)
        plane = [F.when(length > 1e-12, v / length).otherwise(v) for v in plane]
    if face_up:
        down = plane[2] < 0
        plane = [F.when(down, -v).otherwise(v) for v in plane]
    return tuple(plane)
