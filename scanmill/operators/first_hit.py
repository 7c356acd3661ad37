"""Sparse scan of a dense cloud: per ray the first occupied voxel, and in it the point nearest the ray.

The textbook plan joins points to the table of all (ray, voxel) pairs, which has tens of
millions of rows for a 16-row sensor: too large to broadcast, and shuffling dense clouds by
voxel puts every frame's near field on the same few keys. The walk of a ray is a closed form,
so it can be turned round: from a point's voxel follows the step at which any ray could visit
it and the narrow range of slopes such a ray must have. Points therefore look up a table of
rays only, hashed by slope bucket, and the closed form decides the match exactly. Points are
not shuffled before they are reduced to candidates, but for those next to a mount, which meet
the first occupied voxel of each ray.
"""

from __future__ import annotations

from functools import reduce
from math import cos, pi, radians, sqrt, tan
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from scanmill.config import SensorModel
from scanmill.functions.numbers import settled
from scanmill.functions.rays import onto_ray, ray_offset, ray_parameter
from scanmill.functions.voxels import minor_offset, voxel_index
from scanmill.operators.evaluation import computed_once
from scanmill.operators.rays import mount_array, ray_table

FRAME = ("sequence", "frame_index")
SCAN_KEYS = (*FRAME, "sensor")
POINT = ("point_ord", "x", "y", "z", "intensity")
RAY = ("sx", "sy", "sz", "ux", "uy", "uz", "uu")

# Slope buckets per unit of slope, from the mount outwards: a point looks in the level of its own distance in
# cells, where it meets a handful of buckets. A slope lies in [-1, 1].
LEVELS = (1, 2, 4, 8, 16, 32, 64)
_SPAN = 2 * LEVELS[-1] + 1

# Cells from the mount between which rays are matched with occupied voxels before points: there one voxel is on many
# rays. Closer in, a point of a voxel on the ray may lie behind the ray's start.
NEAR = (3, 16)

# Cells from a mount within which a point may be on several rays, so that in a cloud of such points moving them is cheaper
# than moving their pairs.
CLOSE = LEVELS[-1]

# Most rays of one rig: its table (about 150 bytes a row) goes to every executor. The count follows from the
# sensor model alone, never from the data; a larger rig is split by mounts.
RAY_LIMIT = 1_000_000


def _step() -> Column:
    """Cells from the mount's voxel to a point's along the axis on which it is farthest."""
    return F.greatest(F.abs("ox"), F.abs("oy"), F.abs("oz"))


def _direction_key(mount: Column, axis: Column, positive: Column, level: Column, bu: Column, bw: Column) -> Column:
    face = axis * 2 + positive.cast("int")
    cell = (bu + LEVELS[-1]) * _SPAN + (bw + LEVELS[-1])
    # Never null, so that the join adds no null test that repeats the whole expression.
    return F.coalesce((((mount * 6 + face) * (LEVELS[-1] + 1) + level).cast("long") * (_SPAN * _SPAN) + cell), F.lit(-1).cast("long"))


def _axis_views(x: str, y: str, z: str) -> Column:
    """The triple as seen by each possible driving axis: ``(axis, major, u, w)`` rows to explode."""
    orders = ((0, x, y, z), (1, y, x, z), (2, z, x, y))
    return F.array(*[
        F.struct(F.lit(i).alias("axis"), F.col(m).alias("major"), F.col(u).alias("u"), F.col(w).alias("w"))
        for i, m, u, w in orders
    ])


def _directed(rays: DataFrame) -> DataFrame:
    rays = rays.withColumns({f"u{a}": F.col(f"e{a}") - F.col(f"s{a}") for a in "xyz"})
    return rays.withColumn("uu", F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))


def _hashed_rays(rays: DataFrame) -> DataFrame:
    kept = ("sensor", "ray_id", "length", *RAY)
    rays = _directed(rays).select(*kept, "mount", F.col("axis").alias("driving"), F.inline(_axis_views("dx", "dy", "dz")))
    rays = rays.filter(F.col("axis") == F.col("driving"))
    span = F.greatest(F.col("length"), F.lit(1))
    rays = rays.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    bu, bw = (F.floor(F.col(c) * F.col("level") / span).cast("int") for c in "uw")
    key = _direction_key(F.col("mount"), F.col("axis"), F.col("major") > 0, F.col("level"), bu, bw)
    return rays.select(key.alias("direction"), *kept, F.col("u").alias("du"), F.col("w").alias("dw"))


def _may_be_seen(model: SensorModel, voxel_size: float) -> Column:
    """Necessary condition on a point's voxel offset ``(ox, oy, oz)`` from a mount.

    Everything it rejects lies outside every ray's walk (range, opening angle, elevation fan,
    each widened by a few cells), so it only saves lookups.
    """
    ox, oy, oz = F.col("ox").cast("double"), F.col("oy").cast("double"), F.col("oz").cast("double")
    flat = F.greatest(F.abs(ox), F.abs(oy))
    ok = F.greatest(flat, F.abs(oz)) <= model.distance / voxel_size + 2
    if model.half_fov < 180:
        along = ox * F.cos(F.col("yaw")) + oy * F.sin(F.col("yaw"))
        ok = ok & (along >= cos(radians(model.half_fov)) * F.sqrt(ox * ox + oy * oy) - 8.0)
    # A slope over the ground distance lies between its value and root two times it over the larger offset. Walks and
    # ray ends are rounded to cells on every axis: one cell aside moves a ray up by its slope, and an end moved by
    # cells changes the slope the more, the steeper the ray and the shorter its ground track.
    slopes = [tan(radians(e)) for e in model.elevations_deg]
    steepest = max(1.0, *(abs(s) for s in slopes))
    track = model.distance * cos(max(pi / 4, *(abs(radians(e)) for e in model.elevations_deg)))
    slack = 4.0 * voxel_size * sqrt(2.0) * steepest / max(track, 1e-9)
    low = min(s * (sqrt(2.0) if s < 0 else 1.0) for s in slopes) - slack
    high = max(s * (sqrt(2.0) if s > 0 else 1.0) for s in slopes) + slack
    cells = 2.0 * steepest
    return ok & (oz + cells >= low * flat) & (oz - cells <= high * flat)


def _bucket_range(offset: str) -> Column:
    """Slope buckets of the rays that can reach this minor offset after ``step`` cells."""
    most = F.col("level")
    low = F.floor((F.col(offset) - 0.5) / F.col("step") * most - 1e-6)
    high = F.floor((F.col(offset) + 0.5) / F.col("step") * most + 1e-6)
    return F.sequence(F.greatest(low, -most).cast("int"), F.least(high, most).cast("int"))


def _offset_points(points: DataFrame, model: SensorModel, voxel_size: float, precision: str) -> DataFrame:
    """Points once per mount that may see them, with the offset ``ox, oy, oz`` of their voxel from the mount's."""
    intensity = F.col("intensity") if "intensity" in points.columns else F.lit(0.0)
    seen = points.select(
        *FRAME, "point_ord", "x", "y", "z", intensity.cast("float").alias("intensity"),
        *[voxel_index(F.col(a), voxel_size, precision).alias(f"p{a}") for a in "xyz"],
    ).select("*", F.explode(mount_array(model, voxel_size=voxel_size)).alias("m"))
    offsets = {f"o{a}": F.col(f"p{a}") - F.col(f"m.v0{a}") for a in "xyz"}
    seen = seen.select(
        *FRAME, *POINT, F.col("m.mount").alias("mount"), F.col("m.yaw").alias("yaw"), *[o.alias(n) for n, o in offsets.items()],
    )
    return seen.filter(_may_be_seen(model, voxel_size)).drop("yaw").filter(_step() > 0)


def _beside_a_mount(model: SensorModel, voxel_size: float, cells: int = NEAR[1]) -> Column:
    """Necessary condition on a point to lie within so many cells, by default the far end of NEAR: a box around each mount, with two
    cells to spare.

    It only looks at coordinates, so it reaches the scan of the cloud, and the near field costs no second unfolding of all points."""
    reach = (cells + 2) * voxel_size
    boxes = (
        reduce(and_, (F.col(a).between(float(v) - reach, float(v) + reach) for a, v in zip("xyz", (m.x, m.y, m.z))))
        for m in model.mounts
    )
    return reduce(or_, boxes)


def _rays_through(seen: DataFrame, rays: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Rows of ``seen`` (``kept``, mount, ox, oy, oz) with every ray whose walk visits their voxel, and at which step."""
    # A walk's driving axis has the largest offset at every step; on a tie several axes qualify.
    level = F.coalesce(*[F.when(F.col("step") <= n, F.lit(n)) for n in LEVELS], F.lit(LEVELS[-1]))
    seen = seen.select(*kept, "mount", _step().alias("step"), F.inline(_axis_views("ox", "oy", "oz"))).filter(F.abs("major") == F.col("step"))
    seen = seen.withColumn("level", level)
    seen = seen.withColumn("bu", F.explode(_bucket_range("u")))
    seen = seen.withColumn("bw", F.explode(_bucket_range("w")))
    key = _direction_key(F.col("mount"), F.col("axis"), F.col("major") > 0, F.col("level"), F.col("bu"), F.col("bw"))
    seen = seen.select(*kept, "step", "u", "w", key.alias("direction"))

    def visits(delta: str, offset: str) -> Column:
        reached = minor_offset(F.abs(delta), F.col("length"), F.col("step"))
        return (reached == F.abs(offset)) & (F.col(delta) * F.col(offset) >= 0)

    pairs = seen.join(rays, "direction").filter(
        (F.col("step") <= F.col("length")) & visits("du", "u") & visits("dw", "w")
    )
    return pairs.select(*kept, "sensor", "ray_id", "step", *RAY)


def _measured(pairs: DataFrame) -> DataFrame:
    """Pairs of points and rays with the place ``t`` on the ray and the distance ``offset`` from it; points behind drop out."""
    start, direction = (tuple(F.col(f"{p}{a}") for a in "xyz") for p in "su")
    point = tuple(F.col(a).cast("double") for a in "xyz")
    t = settled(ray_parameter(start, direction, F.col("uu"), point), 12)
    pairs = pairs.withColumn("t", t).filter(F.col("t") >= 0)
    pairs = pairs.withColumn("offset", settled(ray_offset(start, direction, point, F.col("t")), 9))
    return pairs.select(*SCAN_KEYS, "ray_id", "step", "offset", "t", *POINT, *[c for c in RAY if c != "uu"])


def _rays(points: DataFrame, model: SensorModel, voxel_size: float, precision: str) -> DataFrame:
    if model.ray_count > RAY_LIMIT:
        raise ValueError(f"{model.ray_count} rays; scan the mounts of a rig beyond {RAY_LIMIT} in several calls")
    return F.broadcast(_hashed_rays(ray_table(points.sparkSession, model, voxel_size, precision)))


def _ray_places(points: DataFrame, model: SensorModel, voxel_size: float, precision: str) -> DataFrame:
    """Start and direction of each ray, by ``mount, ray_id``; of the same bounded size as the table that points look up."""
    return F.broadcast(_directed(ray_table(points.sparkSession, model, voxel_size, precision)).select("mount", "ray_id", "sensor", *RAY))


def ray_candidates(
    points: DataFrame, model: SensorModel, voxel_size: float = 0.1, precision: str = "double"
) -> DataFrame:
    """All (point, ray) pairs where the ray's walk visits the point's voxel.

    ``points`` needs ``sequence, frame_index, point_ord, x, y, z`` and may have ``intensity``
    (zero when absent). Adds ``sensor, ray_id, step, t, offset`` and the ray's start and direction; points behind
    the sensor are dropped.
    """
    seen = _offset_points(points, model, voxel_size, precision)
    return _measured(_rays_through(seen, _rays(points, model, voxel_size, precision), (*FRAME, *POINT)))


def _first_voxels(voxels: DataFrame, rays: DataFrame) -> DataFrame:
    """The first of the occupied ``voxels`` (frame, mount, ox, oy, oz) of NEAR on each ray, and at which step."""
    found = _rays_through(voxels.withColumn("m", F.col("mount")), rays, (*FRAME, "m", "ox", "oy", "oz"))
    # Step and cell as one number: a step has one cell, so the least number is the first voxel.
    span = 2 * NEAR[1] + 1
    digits = [F.col("step").cast("long"), *[F.col(c) + NEAR[1] for c in ("ox", "oy", "oz")]]
    code = reduce(lambda number, digit: number * span + digit, digits)
    first = found.groupBy(*FRAME, "m", "ray_id").agg(F.min(code).alias("v"))
    place = lambda k: F.floor(F.col("v") / span**k).cast("long")
    offsets = {c: (F.pmod(place(k), F.lit(span)) - NEAR[1]).cast("int") for c, k in (("ox", 2), ("oy", 1), ("oz", 0))}
    return first.select(*FRAME, F.col("m").alias("mount"), "ray_id", place(3).cast("int").alias("step"), *[v.alias(c) for c, v in offsets.items()])


def first_candidates(
    points: DataFrame, model: SensorModel, voxel_size: float = 0.1, precision: str = "double"
) -> DataFrame:
    """The pairs of :func:`ray_candidates` that can still be first hits.

    Near a mount a voxel is on up to thousands of rays and may hold many points. There rays meet the distinct
    occupied voxels, a number bounded by the grid and not by the cloud, and each ray keeps its first; only points of
    that voxel are paired with it.
    """
    rays = _rays(points, model, voxel_size, precision)
    seen = _offset_points(points, model, voxel_size, precision)
    near = _step().between(*NEAR)
    others = _rays_through(seen.filter(~near), rays, (*FRAME, *POINT))
    beside = _offset_points(computed_once(points, "x", "y", "z").filter(_beside_a_mount(model, voxel_size)), model, voxel_size, precision).filter(near)
    cell = ("mount", "ox", "oy", "oz")
    # Voxels of a frame share a task, so that the many pairs of rays and voxels are never shuffled: no more of them than
    # cells near the mounts that the rig's rays visit. The number of tasks is fixed, as voxels are small before rays meet them.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    voxels = beside.select(*FRAME, *cell).distinct().repartition(tasks, *[F.col(k) for k in FRAME])
    first = _first_voxels(voxels, rays)
    paired = beside.join(first, [*FRAME, *cell]).select(*FRAME, *POINT, "mount", "ray_id", "step")
    # The rays' places come back at the end, so that shuffles carry numbers only.
    paired = paired.join(_ray_places(points, model, voxel_size, precision), ["mount", "ray_id"])
    return _measured(others.unionByName(paired.select(*others.columns)))


def framed_candidates(
    points: DataFrame, model: SensorModel, voxel_size: float = 0.1, precision: str = "double"
) -> DataFrame:
    """What :func:`first_candidates` gives, less what is no ray's first beyond CLOSE, with a frame's rows in one task.

    Close points are moved to their frame's task before they are multiplied, and their pairs with rays never; the first hits
    beyond them follow.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = [F.col(k) for k in FRAME]
    rays = _rays(points, model, voxel_size, precision)
    far = _offset_points(points, model, voxel_size, precision).filter(_step() > CLOSE)
    far = _firsts(_measured(_rays_through(far, rays, (*FRAME, *POINT)))).repartition(tasks, *frame)

    moved = computed_once(points, "x", "y", "z").filter(_beside_a_mount(model, voxel_size, CLOSE)).repartition(tasks, *frame)
    close = _offset_points(moved, model, voxel_size, precision).filter(_step() <= CLOSE)
    near = _step().between(*NEAR)
    others = _rays_through(close.filter(~near), rays, (*FRAME, *POINT))
    beside = close.filter(near)
    cell = ("mount", "ox", "oy", "oz")
    first = _first_voxels(beside.select(*FRAME, *cell).distinct(), rays)
    # A voxel's points and the rays that end in it meet in a grouping, which finds both in the frame's task; a join on the
    # voxel would shuffle them.
    point = F.struct(*POINT).alias("point")
    none = F.lit(None).cast(beside.select(point).schema[0].dataType).alias("point")
    both = beside.select(*FRAME, *cell, F.lit(None).cast("int").alias("ray_id"), point).unionByName(first.select(*FRAME, *cell, "ray_id", none))
    met = both.groupBy(*FRAME, *cell).agg(F.collect_list("ray_id").alias("rays"), F.collect_list("point").alias("held"))
    met = met.filter(F.size("rays") > 0).select(*FRAME, "mount", _step().alias("step"), "rays", F.inline("held"))
    paired = met.select(*FRAME, *POINT, "mount", F.explode("rays").alias("ray_id"), "step")
    paired = paired.join(_ray_places(points, model, voxel_size, precision), ["mount", "ray_id"])
    return _measured(others.unionByName(paired.select(*others.columns))).unionByName(far)


def _by_ray() -> WindowSpec:
    # Whole numbers first: the sort compares their prefix before it looks at a name.
    return Window.partitionBy("ray_id", "frame_index", "sensor", "sequence").orderBy("step", "offset", "t", "point_ord")


def _firsts(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("_rank", F.row_number().over(_by_ray())).filter(F.col("_rank") == 1).drop("_rank")


def first_hits(
    points: DataFrame, model: SensorModel, voxel_size: float = 0.1, precision: str = "double", by_frame: bool = False
) -> DataFrame:
    """One row per ray with a hit: its first occupied voxel and the representative point in it.

    The top-one window is trimmed inside each map task before its shuffle, so a crowded
    ray costs one row per task.

    ``by_frame`` is for clouds most of whose points lie a few metres from a mount, where they are on tens or hundreds of rays each:
    points are moved to their frame's task and their pairs stay there. The hits are the same; a frame is one task then.
    """
    candidates = framed_candidates if by_frame else first_candidates
    return _firsts(candidates(points, model, voxel_size, precision))


def sparse_scan(
    points: DataFrame, model: SensorModel, voxel_size: float = 0.1, precision: str = "double"
) -> DataFrame:
    """First hits moved onto their rays: ``sequence, frame_index, sensor, ray_id, x, y, z, intensity``.

    Points that coincide as singles are kept once, under the smallest ray. A frame and sensor
    cannot hold more rows than the sensor has rays, so from here on one task may own whole
    scans; the repartition serves this grouping and the joins by scan that follow.
    """
    start, direction = (tuple(F.col(f"{p}{a}") for a in "xyz") for p in "su")
    point = tuple(F.col(a).cast("double") for a in "xyz")
    moved = onto_ray(start, direction, point)
    hits = first_hits(points, model, voxel_size, precision).select(
        *SCAN_KEYS, "ray_id", *[v.cast("float").alias(a) for a, v in zip("xyz", moved)], "intensity"
    )
    return distinct_scan_points(hits.repartition(*[F.col(k) for k in SCAN_KEYS]))


def distinct_scan_points(scan: DataFrame) -> DataFrame:
    """Drop exact repeats of a scan's points; the first ray wins and keeps its intensity."""
    kept = scan.groupBy(*SCAN_KEYS, "x", "y", "z").agg(
        F.min("ray_id").alias("ray_id"), F.min_by("intensity", "ray_id").alias("intensity")
    )
    return kept.select(*SCAN_KEYS, "ray_id", "x", "y", "z", "intensity")
