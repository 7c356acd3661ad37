"""One representative per occupied voxel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.functions.numbers import settled
from scanmill.functions.voxels import voxel_index

FRAME = ("sequence", "frame_index")
VOXEL = ("vx", "vy", "vz")


def with_voxel(points: DataFrame, size: float = 0.1, precision: str = "double") -> DataFrame:
    return points.withColumns({f"v{a}": voxel_index(F.col(a), size, precision) for a in "xyz"})


def voxel_centroids(points: DataFrame, size: float = 0.1, precision: str = "double") -> DataFrame:
    """Mean position per frame and voxel, with the number of points."""
    return with_voxel(points, size, precision).groupBy(*FRAME, *VOXEL).agg(
        *[F.avg(F.col(a).cast("double")).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")
    )


def voxel_nearest(points: DataFrame, size: float = 0.1, precision: str = "double") -> DataFrame:
    """The point nearest the voxel's centre; the earliest in cloud order on a tie.

    The top-one window is trimmed in each map task, so a crowded voxel costs a row per task.
    """
    placed = with_voxel(points, size, precision)
    away = [F.col(a).cast("double") - (F.col(f"v{a}") + 0.5) * size for a in "xyz"]
    distance = settled(F.sqrt(sum((d * d for d in away[1:]), away[0] * away[0])), 9)
    best = Window.partitionBy(*FRAME, *VOXEL).orderBy("_distance", "point_ord")
    return (
        placed.withColumn("_distance", distance)
        .withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") == 1)
        .select(*FRAME, *VOXEL, "point_ord", "x", "y", "z")
    )
