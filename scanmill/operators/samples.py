"""Numbered oriented-box training samples from label lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.config import BEV, Bev
from scanmill.functions.bev import normalised_pixel
from scanmill.functions.boxes import box_corners
from scanmill.functions.text import obb_line, parse_label, sample_stem
from scanmill.operators.splits import requested_sensors
from scanmill.sources.checkpoints import cut_lineage, written

CORNERS = ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")


def parsed_labels(lines: DataFrame) -> DataFrame:
    """Valid boxes of label lines; key columns pass through, ``line`` is replaced by its fields."""
    keys = [c for c in lines.columns if c != "line"]
    parsed = lines.select(*keys, parse_label(F.col("line")).alias("_p")).filter(F.col("_p.class_id").isNotNull())
    return parsed.select(*keys, "_p.*")


def obb_corners(labels: DataFrame) -> DataFrame:
    """Corners ``x1 .. y4`` in sensor-frame metres next to the label's columns."""
    corners = box_corners(*[F.col(c) for c in ("x", "y", "length", "width", "heading")])
    flat = [v for corner in corners for v in corner]
    return labels.withColumns(dict(zip(CORNERS, flat)))


def obb_normalised(labels: DataFrame, bev: Bev = BEV) -> DataFrame:
    """Corners as fractions of the raster, not cut to it, and the text line of the box."""
    keys = [c for c in labels.columns if c not in ("x", "y", "length", "width", "heading")]
    metres = obb_corners(labels)
    placed = {}
    for i in range(1, 5):
        nx, ny = normalised_pixel(F.col(f"x{i}"), F.col(f"y{i}"), bev)
        placed.update({f"x{i}": nx, f"y{i}": ny})
    out = metres.select(*keys, *[placed[c].alias(c) for c in CORNERS])
    return out.withColumn("text", obb_line(F.col("class_id"), [F.col(c) for c in CORNERS]))


def numbered(rows: DataFrame, group: str, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Gapless numbers from zero per group along a total order, without one task per group.

    Rows are range-partitioned once and cut from their lineage there, so that counting and
    numbering see the same partitions even if an executor is lost in between; each partition
    is then shifted by the counts of those before it.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    shifted = ranged.withColumn("_inside", inside).join(shifts, [group, "_part"])
    return shifted.select(*rows.columns, (F.col("_inside") + F.col("_before")).cast("long").alias(name))


def accepted_samples(boxes: DataFrame, rasters: DataFrame) -> DataFrame:
    """Boxes of the stems that have a raster. Stems without a valid box have no row to begin with."""
    keys = [c for c in ("split", "sensor", "stem") if c in rasters.columns]
    return boxes.join(rasters.select(*keys).distinct(), keys, "left_semi")


def sample_numbers(boxes: DataFrame, rasters: DataFrame, sensors: list[str] | None = None) -> DataFrame:
    """``split, sensor, stem, sample_index, n_boxes``: accepted samples numbered per split, sensors in
    the requested order and stems in code-point order within a sensor."""
    order = requested_sensors(sensors)
    position = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("sensor"))
    samples = (
        accepted_samples(boxes, rasters)
        .groupBy("split", "sensor", "stem")
        .agg(F.count(F.lit(1)).alias("n_boxes"))
        .withColumn("_position", position)
        .filter(F.col("_position") > 0)
    )
    return numbered(samples, "split", ["_position", "stem"], "sample_index").drop("_position")


def samples_per_split(numbers: DataFrame) -> DataFrame:
    """``split, n_samples, n_boxes``: totals of the numbered samples."""
    return numbers.groupBy("split").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("n_boxes").alias("n_boxes"))


def sample_mapping(numbers: DataFrame) -> DataFrame:
    """Numbered samples with the ``sequence`` and ``frame_index`` that their stems name."""
    tail = F.regexp_extract("stem", r"_(\d+)$", 1)
    head = F.length("stem") - F.length("sensor") - F.length(tail) - 2
    return numbers.select("*", F.substr("stem", F.lit(1), head).alias("sequence"), tail.try_cast("int").alias("frame_index"))


def obb_samples(lines: DataFrame, rasters: DataFrame, bev: Bev = BEV, sensors: list[str] | None = None) -> DataFrame:
    """Label lines (``split, sensor, stem, line_no, line``) to numbered oriented boxes."""
    boxes = written(parsed_labels(lines))
    numbers = sample_numbers(boxes, rasters, sensors).drop("n_boxes")
    return obb_normalised(boxes.join(numbers, ["split", "sensor", "stem"]), bev)


def split_manifest(numbers: DataFrame, root: str) -> DataFrame:
    """Image path of every numbered sample, sorted per split."""
    path = F.concat(
        F.lit(root.rstrip("/") + "/images/"), F.col("split"), F.lit("/"), sample_stem(F.col("sample_index")), F.lit(".png")
    )
    return numbers.select("split", path.alias("path")).distinct().orderBy("split", "path")
