"""Label rows of kept boxes and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.config import BEV, Bev, SensorModel
from scanmill.functions.angles import angle_difference
from scanmill.functions.boxes import class_name
from scanmill.functions.poses import to_sensor_xyz
from scanmill.functions.text import frame_stem, label_line
from scanmill.operators.first_hit import SCAN_KEYS
from scanmill.operators.sensor_frame import MOUNT_SHIFT, with_mount


def label_rows(kept: DataFrame, model: SensorModel, bev: Bev = BEV) -> DataFrame:
    """One row per kept box: the box in the vehicle frame (``cx .. heading``, for later
    motion) and in its sensor's frame (``xs, ys, zs, heading_s``), with class name and track."""
    placed = with_mount(kept, model, bev.padding, MOUNT_SHIFT)
    xs, ys, zs = to_sensor_xyz(F.col("cx"), F.col("cy"), F.col("cz"), *[F.col(f) for f in MOUNT_SHIFT])
    return placed.select(
        *SCAN_KEYS, "box_ord", class_name(F.col("type")).alias("name"),
        F.coalesce(F.col("track_id"), F.lit("")).alias("track_id"),
        "cx", "cy", "cz", "length", "width", "height", "heading",
        xs.alias("xs"), ys.alias("ys"), zs.alias("zs"),
        angle_difference(F.col("heading"), F.col("yaw")).alias("heading_s"),
    )


def non_empty_scans(scan: DataFrame) -> DataFrame:
    """Keys of the scans that hold a point."""
    return scan.select(*SCAN_KEYS).distinct()


def label_lines(labels: DataFrame, scans: DataFrame) -> DataFrame:
    """Text lines per scan: ``stem, line_no, line``. A scan without boxes keeps one row with a null line."""
    text = labels.select(
        *SCAN_KEYS, "box_ord",
        label_line(*[F.col(c) for c in ("xs", "ys", "zs", "length", "width", "height", "heading_s", "name")]).alias("line"),
    )
    lines = scans.join(text, list(SCAN_KEYS), "left")
    return lines.select(
        *SCAN_KEYS, frame_stem(F.col("sequence"), F.col("sensor"), F.col("frame_index")).alias("stem"),
        F.col("box_ord").alias("line_no"), "line",
    )
