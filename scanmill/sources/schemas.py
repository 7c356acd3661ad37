"""Explicit schemas of the input tables."""

from pyspark.sql import types as T

_KEYS = [T.StructField("sequence", T.StringType()), T.StructField("frame_index", T.IntegerType())]
_VECTOR = T.StructType([T.StructField(a, T.DoubleType()) for a in "xyz"])


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


FRAMES = T.StructType([
    *_KEYS,
    T.StructField("timestamp_micros", T.LongType()),
    T.StructField("pose", T.ArrayType(T.DoubleType())),
])

CALIBRATIONS = T.StructType([
    T.StructField("sequence", T.StringType()),
    T.StructField("laser", T.IntegerType()),
    T.StructField("inclinations", T.ArrayType(T.DoubleType())),
    *_fields(T.DoubleType(), "incl_min", "incl_max"),
    T.StructField("extrinsic", T.ArrayType(T.DoubleType())),
])

RANGE_IMAGES = T.StructType([
    *_KEYS,
    *_fields(T.IntegerType(), "laser", "ret", "height", "width", "channels"),
    T.StructField("data", T.ArrayType(T.FloatType())),
    T.StructField("pixel_pose", T.ArrayType(T.FloatType())),
])

POINTS = T.StructType([
    *_KEYS,
    T.StructField("point_ord", T.LongType()),
    *_fields(T.FloatType(), "x", "y", "z", "intensity"),
])

BOXES = T.StructType([
    *_KEYS,
    T.StructField("box_ord", T.IntegerType()),
    *_fields(T.DoubleType(), "cx", "cy", "cz", "length", "width", "height", "heading"),
    T.StructField("type", T.IntegerType()),
    T.StructField("track_id", T.StringType()),
    T.StructField("speed", _VECTOR),
    T.StructField("accel", _VECTOR),
    *_fields(T.IntegerType(), "num_points", "difficulty", "tracking_difficulty"),
])

SCAN = T.StructType([
    *_KEYS,
    T.StructField("sensor", T.StringType()),
    T.StructField("ray_id", T.IntegerType()),
    *_fields(T.FloatType(), "x", "y", "z", "intensity"),
])

_BOX_RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("name", "track_id")],
    *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("location", "dimensions")],
    T.StructField("heading", T.DoubleType()),
])

TRACK_RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("horizon", "split", "sensor", "run", "sequence_name")],
    *_fields(T.IntegerType(), "frame_index", "num_frames"),
    T.StructField("frames", T.ArrayType(T.StructType([
        T.StructField("frame_id", T.IntegerType()), T.StructField("annos", T.ArrayType(_BOX_RECORD)),
    ]))),
])

TABLES = {
    "frames": FRAMES,
    "calibrations": CALIBRATIONS,
    "range_images": RANGE_IMAGES,
    "points": POINTS,
    "boxes": BOXES,
    "scan": SCAN,
}
