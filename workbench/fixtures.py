"""Driving-recording tables derived from the given tables. Every view reads its table whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.config import MODELS, SENSOR_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bin(column: str, width: float) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("int")


def _segment(seq: Column) -> Column:
    return F.concat(F.lit("segment-"), F.lpad(seq.cast("string"), 4, "0"))


def frame_keys() -> list[Column]:
    """Sequence and frame index of a running frame number; ten frames make a sequence."""
    seq = F.floor(F.col("frame_no") / 10).cast("int")
    return [_segment(seq).alias("sequence"), (F.col("frame_no") - 10 * seq).alias("frame_index")]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per 75 orders; the customer of its first order shakes pose and clock."""
    heads = (
        table(spark, sf_dir, "orders")
        .groupBy(_bin("o_orderkey", 75.0).alias("frame_no"))
        .agg(F.min_by("o_custkey", "o_orderkey").alias("cust"))
        .withColumn("seq", F.floor(F.col("frame_no") / 10).cast("int"))
        .withColumn("n", F.col("frame_no") - 10 * F.col("seq"))
        .withColumn("yaw", 0.05 * F.col("n") + 0.001 * (F.col("cust") % 10))
        .withColumn("pit", 0.01 * (F.col("cust") % 3))
    )
    cy, sy, cp, sp = F.cos("yaw"), F.sin("yaw"), F.cos("pit"), F.sin("pit")
    pose = [
        cy * cp, -sy, cy * sp, 100.0 * F.col("seq") + 1.5 * F.col("n"),
        sy * cp, cy, sy * sp, -20.0 * F.col("seq") + 0.2 * F.col("n"),
        -sp, F.lit(0.0), cp, 0.01 * (F.col("cust") % 5),
        F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0),
    ]
    stamp = (
        F.lit(1704067200000000) + F.col("seq").cast("long") * 60000000 + F.col("n") * 100000
        + (F.col("cust") % 7) * 1000
    )
    return heads.select(
        _segment(F.col("seq")).alias("sequence"), F.col("n").alias("frame_index"),
        stamp.alias("timestamp_micros"), F.array(*pose).alias("pose"), "frame_no",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cloud near the beams of the centre mount; every eleventh frame lies out of reach of all."""
    lines = table(spark, sf_dir, "lineitem").withColumn("frame_no", _bin("l_orderkey", 75.0))
    r = F.lit(5.0) + F.col("l_quantity") + F.when(F.col("frame_no") % 11 == 5, 150.0).otherwise(0.0)
    az = F.radians(F.lit(-72.5) + 0.25 * (F.col("l_partkey") % 581))
    row = F.col("l_linenumber") % 3
    el = F.radians(F.when(row == 0, -0.4).when(row == 1, 0.4).otherwise(1.2))
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    placed = lines.select(
        "frame_no", *order,
        F.round(F.lit(3.61) + r * F.cos(el) * F.cos(az), 6).alias("x"),
        F.round(F.lit(-0.154) + r * F.cos(el) * F.sin(az), 6).alias("y"),
        F.round(F.lit(0.338) + r * F.sin(el) + F.col("l_discount") * 0.5, 6).alias("z"),
        F.col("l_tax").alias("intensity"),
    )
    ordinal = F.row_number().over(Window.partitionBy("frame_no").orderBy(*order)).cast("long")
    return placed.select(*frame_keys(), ordinal.alias("point_ord"), "x", "y", "z", "intensity", "frame_no")


def near_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense cloud with every point on a ring of 0.15 to five metres around a mount, mounts in turn."""
    mounts = MODELS["scala"].mounts
    pick = lambda field: F.element_at(F.array(*[F.lit(float(getattr(m, field))) for m in mounts]), (F.col("point_ord") % len(mounts)).cast("int") + 1)
    r = 0.15 + 0.01 * (F.col("point_ord") * 37 % 486)
    az = F.radians(pick("yaw_deg") - 70 + 0.25 * (F.col("point_ord") * 11 % 561))
    height = 0.01 * (F.col("point_ord") % 7 - 3)
    placed = {"x": pick("x") + r * F.cos(az), "y": pick("y") + r * F.sin(az), "z": pick("z") + r * height}
    return points(spark, sf_dir).withColumns({a: F.round(v, 6) for a, v in placed.items()})


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten boxes per frame, all type codes, bearings all round."""
    p, size = F.col("p_partkey"), F.col("p_size")
    far, bearing = 4 + size * 0.4, F.radians((p * 37 % 360 - 180).cast("double"))
    parts = table(spark, sf_dir, "part").withColumn("frame_no", _bin("p_partkey", 10.0))
    motion = [F.struct(*[(0.1 * (p % n)).alias(a) for a, n in zip("xyz", m)]) for m in ((7, 5, 3), (4, 6, 2))]
    return parts.select(
        *frame_keys(), (p % 10).cast("int").alias("box_ord"),
        F.round(3.61 + far * F.cos(bearing), 6).alias("cx"),
        F.round(-0.154 + far * F.sin(bearing), 6).alias("cy"),
        F.lit(0.8).alias("cz"),
        (4.0 + size % 5).alias("length"), (2.0 + (p % 3) * 0.5).alias("width"), F.lit(2.0).alias("height"),
        F.round((p % 63) * 0.1 - 3.1, 6).alias("heading"),
        (p % 5).cast("int").alias("type"), F.concat(F.lit("trk"), (p % 10).cast("string")).alias("track_id"),
        motion[0].alias("speed"), motion[1].alias("accel"),
        (p % 97).cast("int").alias("num_points"), (p % 3).cast("int").alias("difficulty"),
        (p % 4).cast("int").alias("tracking_difficulty"),
    )


SENSORS = SENSOR_NAMES


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lasers per sequence: odd ones list their beams, even ones give a range."""
    heads = frames(spark, sf_dir).select("sequence", F.floor(F.col("frame_no") / 10).alias("seq")).distinct()
    lasers = heads.select("*", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("laser"))
    listed = F.array(*[F.lit(0.3 - 0.05 * (7 - i)) for i in range(8)])
    yaw = 0.1 * F.col("laser") + 0.001 * (F.col("seq") % 7)
    extrinsic = [
        F.cos(yaw), -F.sin(yaw), F.lit(0.0), 0.5 * F.col("laser"),
        F.sin(yaw), F.cos(yaw), F.lit(0.0), F.lit(-0.1),
        F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.5),
        F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0),
    ]
    return lasers.select(
        "sequence", "laser",
        F.when(F.col("laser") % 2 == 1, listed).otherwise(F.array().cast("array<double>")).alias("inclinations"),
        F.lit(-0.1).alias("incl_min"), F.lit(0.3).alias("incl_max"), F.array(*extrinsic).alias("extrinsic"),
    )


def range_images(spark: SparkSession, sf_dir: str, with_pose: bool = False) -> DataFrame:
    """An 8 x 8 image of four channels per vector; top-laser images may carry a pose per pixel."""
    vec = F.col("vec_id")
    data = F.flatten(F.transform(
        F.col("embedding"),
        lambda v, i: F.array(
            F.floor(v.cast("double") * 1000) / 10.0,
            F.floor(F.abs(v.cast("double")) * 1000) / 1000.0,
            F.lit(0.0),
            F.when((i + vec) % 17 == 0, 1.0).otherwise(-1.0),
        ),
    )).cast("array<float>")
    images = table(spark, sf_dir, "embeddings").withColumn("frame_no", _bin("vec_id", 10.0))
    pose = F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.array(
            0.001 * (i % 7), 0.002 * (i % 5), 0.01 * (F.col("frame_no") % 10) + 0.001 * (i % 3),
            10.0 * F.col("frame_no") + 0.01 * i, 0.02 * i - 1.0, 0.1 * (i % 4),
        ),
    )).cast("array<float>")
    laser = (vec % 5 + 1).cast("int")
    return images.select(
        *frame_keys(), laser.alias("laser"), (vec % 2).cast("int").alias("ret"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(4).alias("channels"), data.alias("data"),
        *([F.when(laser == 1, pose).alias("pixel_pose")] if with_pose else []),
    )


def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines: every thirteenth is one token short, two of five classes are unknown."""
    p = F.col("p_partkey")
    seq = F.floor(p / 100).cast("int")
    sensor = _pick(SENSORS, seq % 6)
    frame = F.lpad((F.floor(p / 10).cast("int") % 10).cast("string"), 3, "0")
    kind = p % 5
    name = F.when(kind == 1, "Vehicle").when(kind == 2, "Pedestrian").when(kind == 4, "Cyclist").otherwise("Unknown")
    line = F.concat_ws(
        " ", F.col("p_size").cast("string"), (p % 21 - 10).cast("string"), F.lit("0.5"), F.lit("4.5"), F.lit("1.9"),
        F.lit("1.6"), (p % 3 - 1).cast("string"), F.when(p % 13 != 0, name),
    )
    return table(spark, sf_dir, "part").select(
        F.when(seq % 5 < 4, "train").otherwise("val").alias("split"), sensor.alias("sensor"),
        F.concat_ws("_", _segment(seq), sensor, frame).alias("stem"), (p % 10).alias("line_no"), line.alias("line"),
    )


def rasters_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems with a raster: a seventh of the frames have none."""
    seq = F.floor(F.col("frame_no") / 10).cast("int")
    sensor = _pick(SENSORS, seq % 6)
    frame = F.lpad(F.col("frame_index").cast("string"), 3, "0")
    return frames(spark, sf_dir).filter(F.col("frame_no") % 7 != 3).select(
        F.when(seq % 5 < 4, "train").otherwise("val").alias("split"), sensor.alias("sensor"),
        F.concat_ws("_", F.col("sequence"), sensor, frame).alias("stem"),
    )


def sensor_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part under a folder name; two of eight names are no sensors."""
    names = (*SENSORS, "side_left", "roof")
    return table(spark, sf_dir, "part").select(_pick(names, F.col("p_partkey") % 8).alias("sensor"))


def split_list(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Names per split, with two that do not exist. ``repeats`` lists each number of a sequence: beyond 9,999 of them several
    numbers share a name, as names hold four digits."""
    seq = F.floor(F.col("frame_no") / 10).cast("int")
    numbers = frames(spark, sf_dir).select(F.when(seq % 5 < 4, "train").otherwise("val").alias("split"), "sequence", seq.alias("seq"))
    listed = (numbers if repeats else numbers.drop("seq")).distinct().select("split", "sequence")
    gone = spark.createDataFrame(
        [("train", "segment-missing-1"), ("val", "segment-missing-2")], "split string, sequence string"
    )
    return listed.unionByName(gone)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split list with the number of each sequence as its listing; names that do not exist have none."""
    seq = F.floor(F.col("frame_no") / 10).cast("long")
    split = F.when(seq % 5 < 4, "train").otherwise("val")
    numbers = frames(spark, sf_dir).select(split.alias("split"), "sequence", seq.alias("listing")).distinct()
    gone = split_list(spark, sf_dir).filter(F.col("sequence").startswith("segment-missing"))
    return numbers.unionByName(gone.withColumn("listing", F.lit(None).cast("long")))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground planes; every fourth faces down."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("plane_id"), (0.02 * (k % 5 - 2)).alias("a"), (0.01 * (k % 7 - 3)).alias("b"),
        F.when(k % 4 == 0, -1.0).otherwise(1.0).alias("c"), (0.1 * (k % 9)).alias("d"),
    )
