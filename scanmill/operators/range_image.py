"""Range images to points of the vehicle frame."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.poses import apply_motion, inverse, motion_of, rotation_from_rpy

# Lasers used, the laser whose pixels carry poses, image channels, the mark of a
# pixel inside a no-label zone.
LASERS = (1, 2, 3, 4, 5)
TOP_LASER = 1
RANGE, INTENSITY, NO_LABEL_ZONE = 0, 1, 3
IN_ZONE = 1.0


def beam_inclination(inclinations: Column, low: Column, high: Column, height: Column, row: Column) -> Column:
    """Inclination of an image row: the listed beams, or even steps; rows run from the last beam to the first."""
    listed = F.try_element_at(inclinations, (height - row).cast("int"))
    even = (height - row - 0.5) / height * (high - low) + low
    return F.when(F.coalesce(F.size(inclinations), F.lit(0)) > 0, listed).otherwise(even)


def column_azimuth(extrinsic: Column, width: Column, column: Column) -> Column:
    share = (width - column - 0.5) / width
    return (share * 2.0 - 1.0) * pi - F.atan2(extrinsic[4], extrinsic[0])


def range_image_points(
    range_images: DataFrame, calibrations: DataFrame, frames: DataFrame | None = None,
    lasers: tuple[int, ...] = LASERS, drop_no_label_zone: bool = True,
) -> DataFrame:
    """One row per valid pixel: ``sequence, frame_index, laser, ret, idx, x, y, z, intensity``.

    Images are arrays ``data[height x width x channels]``. A row of the top laser may carry
    ``pixel_pose[height x width x 6]`` (roll, pitch, yaw, x, y, z in the world); given ``frames``, its
    pixels are placed by their own pose and brought back by the frame's. Pixels whose frame is not in ``frames`` drop out.

    Image rows are wide, so they are read once and unpacked where they are read; calibrations and frame poses
    meet narrow pixels, and Spark chooses each join by the tables' sizes.
    """
    keys = [k for k in ("sequence", "laser") if k in calibrations.columns]
    posed = frames is not None and "pixel_pose" in range_images.columns
    pixels = _pixels(range_images.filter(F.col("laser").isin(*lasers)), drop_no_label_zone, posed)
    placed = _placed(pixels.join(calibrations, keys), posed)
    out = ("sequence", "frame_index", "laser", "ret", "idx")
    xyz = [F.col(a) for a in "xyz"]
    if posed:
        # Only pixels in the world look for their frame: the others stay one row each, whatever the frame table holds.
        poses = frames.select(F.col("sequence").alias("_sequence"), F.col("frame_index").alias("_frame"), "pose")
        own = (F.col("sequence") == F.col("_sequence")) & (F.col("frame_index") == F.col("_frame")) & F.col("in_world")
        placed = placed.join(poses, own, "left").filter(~F.col("in_world") | F.col("pose").isNotNull())
        back = apply_motion(inverse(motion_of(F.col("pose"))), *xyz)
        xyz = [F.when(F.col("in_world"), b).otherwise(v) for b, v in zip(back, xyz)]
    return placed.select(*out, *[v.cast("float").alias(a) for a, v in zip("xyz", xyz)], "intensity")


def _pixels(images: DataFrame, drop_no_label_zone: bool, posed: bool) -> DataFrame:
    """Valid pixels with their range, place in the image and, where they have one, their own pose."""
    pixels = images.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("idx")
    )

    def value(channel: int) -> Column:
        return F.col("data")[F.col("idx") * F.col("channels") + channel].cast("double")

    valid = value(RANGE) > 0
    if drop_no_label_zone:
        valid = valid & (value(NO_LABEL_ZONE) != IN_ZONE)
    in_world = F.lit(False)
    own = []
    if posed:
        in_world = (F.col("laser") == TOP_LASER) & F.col("pixel_pose").isNotNull()
        own = [F.when(in_world, F.col("pixel_pose")[F.col("idx") * 6 + i].cast("double")).alias(f"_p{i}") for i in range(6)]
    return pixels.filter(valid).select(
        "sequence", "frame_index", "laser", "ret", "idx", "height", "width", value(RANGE).alias("_range"),
        value(INTENSITY).cast("float").alias("intensity"), in_world.alias("in_world"), *own,
    )


def _placed(pixels: DataFrame, posed: bool) -> DataFrame:
    """Pixels as points: of the vehicle frame, or of the world where they have a pose."""
    row = F.floor(F.col("idx") / F.col("width"))
    polar = pixels.withColumns({
        "_inc": beam_inclination(F.col("inclinations"), F.col("incl_min"), F.col("incl_max"), F.col("height"), row),
        "_az": column_azimuth(F.col("extrinsic"), F.col("width"), F.col("idx") % F.col("width")),
    })
    flat = F.col("_range") * F.cos("_inc")
    xyz = apply_motion(
        motion_of(F.col("extrinsic")), flat * F.cos("_az"), flat * F.sin("_az"), F.col("_range") * F.sin("_inc")
    )
    if posed:
        turn = rotation_from_rpy(F.col("_p0"), F.col("_p1"), F.col("_p2"))
        world = apply_motion({**turn, **{f"t{i}": F.col(f"_p{3 + i}") for i in range(3)}}, *xyz)
        xyz = [F.when(F.col("in_world"), w).otherwise(v) for w, v in zip(world, xyz)]
    return polar.select(
        "sequence", "frame_index", "laser", "ret", "idx", *[v.alias(a) for a, v in zip("xyz", xyz)], "intensity", "in_world",
    )


def dense_points(pixels: DataFrame) -> DataFrame:
    """Dense clouds from unpacked pixels, with ``point_ord`` in the order return, laser, row, column.

    The ordinal packs its parts into one long, so it needs no sort; it is not gapless.
    """
    order = (F.col("ret").cast("long") * 64 + F.col("laser")) * F.lit(1 << 32) + F.col("idx")
    return pixels.select("sequence", "frame_index", order.alias("point_ord"), "x", "y", "z", "intensity")
