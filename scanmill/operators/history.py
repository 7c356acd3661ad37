"""The last few non-empty scans of the same sequence and sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.functions.poses import (
    MOTION_FIELDS, motion_columns, motion_of, planar_of, relative_motion, rigid_pose,
)

# Fixed value: current frame plus three earlier ones.
MAX_FRAMES = 4

# Frames per chunk when ranks are counted; see ``rank_in_group``.
CHUNK = 1024


def rank_in_group(rows: DataFrame, keys: list[str], order: str, chunk: int = CHUNK, ties: list[str] | None = None) -> DataFrame:
    """Add ``rank`` (from one) of each row in its group by an integer column, equal values by the columns of ``ties``.

    Ranks are counted inside chunks of the order column and shifted by the counts of the
    chunks before, so a group of any size is spread over many tasks. Rows that are equal in all of these columns have no
    order: they are an error.
    """
    total = [order, *(ties or [])]
    chunked = rows.withColumn("_chunk", F.floor(F.col(order) / chunk))
    window = Window.partitionBy(*keys, "_chunk").orderBy(*total)
    same = F.lag(F.struct(*total)).over(window) == F.struct(*total)
    place = F.row_number().over(window)
    message = F.concat(F.lit(f"rows without an order by {total}: "), F.to_json(F.struct(*keys, *total)))
    inside = chunked.withColumn("_inside", F.when(same, F.raise_error(message).cast("int")).otherwise(place))
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = inside.join(shifts, [*keys, "_chunk"])
    return ranked.select(*rows.columns, (F.col("_inside") + F.col("_before")).cast("long").alias("rank"))


def frame_ordinals(frames: DataFrame, chunk_micros: int = 600_000_000, ties: list[str] | None = None) -> DataFrame:
    """Add ``frame_index`` (from zero, by time) to frames that come without one.

    Frames of a sequence with equal time stamps are numbered by the columns of ``ties``, such as the record's position;
    without them, or where those are equal too, they are an error."""
    ranked = rank_in_group(frames, ["sequence"], "timestamp_micros", chunk_micros, ties)
    return ranked.select(*frames.columns, (F.col("rank") - 1).cast("int").alias("frame_index"))


def history_pairs(scans: DataFrame, max_frames: int = MAX_FRAMES) -> DataFrame:
    """``sequence, sensor, frame_index, source_frame, k``: each non-empty scan with itself
    (k = 0) and up to ``max_frames - 1`` earlier non-empty ones, newest first.

    Every scan offers itself to its own rank and the next ones. The offers on one rank, at most
    ``max_frames`` rows, are that rank's history, and the offer with k = 0 names its frame:
    no self-join is needed and no pair is formed that is not kept.
    """
    ranked = rank_in_group(scans.select("sequence", "sensor", "frame_index"), ["sequence", "sensor"], "frame_index")
    offers = ranked.select(
        "sequence", "sensor", F.col("frame_index").alias("source_frame"), "rank",
        F.explode(F.sequence(F.lit(0), F.lit(max_frames - 1))).alias("k"),
    ).withColumn("rank", F.col("rank") + F.col("k"))
    slot = Window.partitionBy("sequence", "sensor", "rank")
    owner = F.max(F.when(F.col("k") == 0, F.col("source_frame"))).over(slot)
    pairs = offers.withColumn("frame_index", owner).filter(F.col("frame_index").isNotNull())
    return pairs.select("sequence", "sensor", "frame_index", "source_frame", "k")


def history_with_motion(pairs: DataFrame, frames: DataFrame, convention: str = "vehicle_to_world") -> DataFrame:
    """Pairs with both time stamps, the motion source frame -> target frame, and both planar poses.

    For k = 0 the motion is exactly the identity. Poses are taken apart into columns before
    the joins, so that the rows that meet are flat.
    """
    pose = motion_of(rigid_pose(F.col("pose"), frame=F.concat_ws("/", "sequence", "frame_index")))
    heads = frames.select("sequence", "frame_index", "timestamp_micros", *[v.alias(n) for n, v in pose.items()])
    source = heads.select(
        "sequence", F.col("frame_index").alias("source_frame"), F.col("timestamp_micros").alias("source_micros"),
        *[F.col(n).alias(f"source_{n}") for n in MOTION_FIELDS],
    )
    both = pairs.join(heads, ["sequence", "frame_index"]).join(source, ["sequence", "source_frame"])
    there, here = motion_columns("source_"), motion_columns()
    still = F.col("k") == 0
    planar = {
        f"{prefix}{field}": value
        for prefix, m in (("here_", here), ("there_", there))
        for field, value in zip(("x", "y", "yaw"), planar_of(m))
    }
    return both.select(
        *pairs.columns, "timestamp_micros", "source_micros",
        *[
            F.when(still, F.lit(1.0 if n in ("r00", "r11", "r22") else 0.0)).otherwise(v).alias(n)
            for n, v in relative_motion(there, here, convention).items()
        ],
        *[v.alias(n) for n, v in planar.items()],
    )
