"""Moving points, planes and scans into the frame of each mount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.config import BEV, Bev, SensorModel
from scanmill.functions.poses import plane_to_sensor, to_sensor_xyz
from scanmill.operators.rays import mount_array

MOUNT_SHIFT = ("tx", "ty", "tz", "yaw")


def with_mount(df: DataFrame, model: SensorModel, padding: float | None, fields: tuple[str, ...]) -> DataFrame:
    """Add the named mount fields to rows that carry a ``sensor``; rows of other sensors drop out.

    The handful of mounts is a literal map, looked up per row: no join.
    """
    structs = mount_array(model, padding)
    by_name = F.map_from_arrays(F.array(*[F.lit(m.name) for m in model.mounts]), structs)
    found = df.withColumn("_mount", F.try_element_at(by_name, F.col("sensor")))
    found = found.filter(F.col("_mount").isNotNull())
    return found.select(*df.columns, *[F.col(f"_mount.{f}").alias(f) for f in fields])


def scan_to_sensor(scan: DataFrame, model: SensorModel, bev: Bev = BEV, padded: bool = True) -> DataFrame:
    """The scan with x, y, z in its own sensor's frame; all other columns pass through."""
    placed = with_mount(scan, model, bev.padding if padded else None, MOUNT_SHIFT)
    xyz = [F.col(a).cast("double") for a in "xyz"]
    moved = to_sensor_xyz(*xyz, *[F.col(f) for f in MOUNT_SHIFT])
    return placed.withColumns({a: v.cast("float") for a, v in zip("xyz", moved)}).select(*scan.columns)


def points_single(scan: DataFrame, model: SensorModel, bev: Bev = BEV) -> DataFrame:
    """One-frame clouds: x, y, z, intensity in the sensor frame."""
    return scan_to_sensor(scan, model, bev).select(
        "sequence", "frame_index", "sensor", "ray_id", "x", "y", "z", "intensity"
    )


def planes_to_sensors(
    planes: DataFrame, model: SensorModel, bev: Bev = BEV, padded: bool = True,
    normalise: bool = True, face_up: bool = True,
) -> DataFrame:
    """Every plane ``(a, b, c, d)`` in every mount's frame; key columns pass through."""
    keys = [c for c in planes.columns if c not in ("a", "b", "c", "d")]
    fanned = planes.select("*", F.explode(mount_array(model, bev.padding if padded else None)).alias("_m"))
    plane = [F.col(n).cast("double") for n in "abcd"]
    moved = plane_to_sensor(*plane, *[F.col(f"_m.{f}") for f in MOUNT_SHIFT], normalise, face_up)
    return fanned.select(
        *keys, F.col("_m.sensor").alias("sensor"),
        *[v.cast("float" if n != "d" else "double").alias(n) for n, v in zip("abcd", moved)],
    )
