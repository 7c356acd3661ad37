"""The first-hit join against a walk of every ray, and hand-made ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.config import MODELS, SensorModel, SensorMount, sensor_model
from scanmill.operators import first_hit
from scanmill.operators.rays import ray_cells, ray_table, sensor_table, walked
from scanmill.operators.voxel_groups import with_voxel

POINT = "sequence string, frame_index int, point_ord long, x double, y double, z double, intensity float"
ONE_RAY = SensorModel("one", (SensorMount("m", 0.05, 0.05, 0.05, 0.0),), 20.0, -1.0, 1.0, (0.0,), azimuth_bands=((0.0, 0.0, 1.0),))


def cloud(spark, rows):
    return spark.createDataFrame([("s", 0, i, *r) for i, r in enumerate(rows)], POINT)


def test_ray_counts():
    assert MODELS["scala"].rays_per_mount == 581 * 3
    assert MODELS["scala2"].rays_per_mount == 653 * 16
    with pytest.raises(ValueError):
        sensor_model("radar")
    assert [m.name for m in sensor_model("scala", ["rear_left", "front_left"]).mounts] == ["front_left", "rear_left"]


@pytest.mark.parametrize("name", ["scala", "scala2"])
def test_ray_ends_and_order(spark, name):
    model = MODELS[name]
    if name == "scala":
        az = np.round(np.linspace(model.fov_min, model.fov_max, 581), 2)
    else:
        az = np.concatenate([np.arange(-66.5, -15.2, 0.25), np.arange(-15, 15.1, 0.125), np.arange(15.25, 66.6, 0.25)])
        assert (np.diff(az) > 0).all() and len(az) == 653
    rays = ray_table(spark, model).orderBy("mount", "ray_id").toPandas()
    for i, mount in enumerate(model.mounts):
        h, v = np.meshgrid(np.radians(az + mount.yaw_deg), np.radians(model.elevations_deg))
        want = model.distance * np.stack([np.cos(v) * np.cos(h), np.cos(v) * np.sin(h), np.sin(v)], -1).reshape(-1, 3)
        own = rays[rays["mount"] == i]
        assert own["ray_id"].tolist() == list(range(model.rays_per_mount))
        assert np.abs(own[["ex", "ey", "ez"]].to_numpy() - want - [mount.x, mount.y, mount.z]).max() < 1e-6


def test_sensor_table(spark):
    row = sensor_table(spark, MODELS["scala"], 3.7).filter("sensor = 'front_left'").first()
    assert math.isclose(row.tx, 3.7 - 3.255) and row.ty == 0.885 and (row.fov_min, row.fov_max) == (-6.5, 138.5)
    assert sensor_table(spark, MODELS["scala"]).filter("sensor = 'rear_left'").first().tx == -0.825


@pytest.mark.parametrize("precision", ["double", "float"])
@pytest.mark.parametrize("name", ["scala", "scala2", "steep"])
def test_lookup_equals_walking_every_cell(spark, name, precision):
    """Random clouds, dense near the mounts, where a voxel is crossed by many rays."""
    if name == "steep":
        model = SensorModel(
            "steep", (SensorMount("a", 0.3, -0.2, 0.1, 33.0), SensorMount("b", -1.0, 0.0, 0.0, 180.0)), 12.0, -170.0, 170.0,
            (-85.0, -50.0, -45.0, 0.0, 44.0, 45.0, 60.0, 90.0), azimuth_steps=68,
        )
    else:
        model = MODELS[name].select(["front_left", "rear_center"] if name == "scala" else ["rear_right"])
    rng = np.random.default_rng(11)
    n = 1500
    centre = np.array([[m.x, m.y, m.z] for m in model.mounts])[rng.integers(0, len(model.mounts), n)]
    spread = rng.choice([0.3, 3.0, 60.0], n)[:, None]
    xyz = centre + rng.normal(size=(n, 3)) * spread * np.array([1, 1, 1.0 if name == "steep" else 0.05])
    points = cloud(spark, [(*map(float, p), 0.5) for p in np.round(xyz, 6)])
    got = first_hit.ray_candidates(points, model, precision=precision).select("sensor", "ray_id", "step", "point_ord")

    cells = ray_cells(ray_table(spark, model, precision=precision)).select("sensor", "ray_id", "step", "vx", "vy", "vz", *[
        c for a in "xyz" for c in (f"s{a}", f"e{a}")])
    pairs = with_voxel(points, 0.1, precision).join(cells, ["vx", "vy", "vz"])
    ahead = sum((F.col(a) - F.col(f"s{a}")) * (F.col(f"e{a}") - F.col(f"s{a}")) for a in "xyz")
    want = pairs.filter(ahead >= -1e-9).select("sensor", "ray_id", "step", "point_ord")
    a, b = ({tuple(r) for r in df.collect()} for df in (got, want))
    assert a == b and len(a) > 100
    assert got.count() == len(a)


@pytest.mark.parametrize("name", ["scala", "scala2"])
def test_first_candidates_keep_every_first_hit(spark, name):
    """The near field's short cut gives the hits of all candidates, and far fewer pairs."""
    model = MODELS[name].select(["front_left"])
    mount = model.mounts[0]
    rng = np.random.default_rng(5)
    r, az = rng.uniform(0.3, 1.7, 2000), np.radians(mount.yaw_deg + rng.uniform(-60, 60, 2000))
    xyz = np.stack([mount.x + r * np.cos(az), mount.y + r * np.sin(az), mount.z + r * rng.uniform(-0.03, 0.03, 2000)], -1)
    points = cloud(spark, [(*map(float, p), 0.5) for p in np.round(xyz, 6)])
    every, few = first_hit.ray_candidates(points, model), first_hit.first_candidates(points, model)
    ray = Window.partitionBy("sensor", "ray_id").orderBy("step", "offset", "t", "point_ord")
    top = lambda df: {tuple(x) for x in df.withColumn("n", F.row_number().over(ray)).filter("n = 1").select("sensor", "ray_id", "step", "point_ord").collect()}
    assert top(every) == top(few) and few.count() < every.count() / 2


@pytest.mark.parametrize("name", ["scala", "scala2"])
def test_hits_by_frame_are_the_same_and_their_pairs_stay(spark, name):
    """Points close to the mounts and far from them, some in one voxel; what is shuffled by frame is points and far hits."""
    model = MODELS[name].select(["front_left", "front_center"])
    rng = np.random.default_rng(7)
    mount = np.array([[m.x, m.y, m.z] for m in model.mounts])[rng.integers(0, 2, 1500)]
    r, az = rng.choice([0.2, 0.9, 4.0, 30.0], 1500) * rng.uniform(0.8, 1.2, 1500), np.radians(rng.uniform(-60, 100, 1500))
    xyz = mount + np.stack([r * np.cos(az), r * np.sin(az), r * rng.uniform(-0.05, 0.05, 1500)], -1)
    m = model.mounts[1]
    out = [(m.x + 30 * math.cos(math.radians(a)), m.y + 30 * math.sin(math.radians(a)), m.z + 30 * math.tan(math.radians(e))) for a in range(0, 40) for e in model.elevations_deg]
    points, beyond = (cloud(spark, [(*map(float, p), 0.5) for p in np.round(ps, 6)]) for ps in (np.concatenate([xyz, xyz[:200] + 0.003]), out))
    points = points.unionByName(beyond.withColumn("frame_index", F.lit(1)))
    hits = {b: first_hit.first_hits(points, model, by_frame=b) for b in (False, True)}
    a, b = ({tuple(r) for r in h.select("frame_index", "sensor", "ray_id", "step", "point_ord", "x", "intensity").collect()} for h in hits.values())
    assert a == b and len({r[3] for r in a if r[3] < 3}) > 0 and any(r[3] > 64 for r in a)
    plan = hits[True]._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_NUM" not in line for line in shuffles) == 1, "first hits beyond the close field only"
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def winner(spark, rows):
    return first_hit.first_hits(cloud(spark, rows), ONE_RAY).select("step", "point_ord").collect()


def test_nearest_cell_wins_then_offset_then_distance_then_order(spark):
    far, near = (5.05, 0.05, 0.05, 0.1), (2.05, 0.09, 0.05, 0.2)
    assert [tuple(r) for r in winner(spark, [far, near])] == [(20, 1)]
    assert [tuple(r) for r in winner(spark, [(2.05, 0.09, 0.05, 0.1), (2.05, 0.06, 0.05, 0.2)])] == [(20, 1)]
    assert [tuple(r) for r in winner(spark, [(2.07, 0.06, 0.05, 0.1), (2.03, 0.04, 0.05, 0.2)])] == [(20, 1)]
    assert [tuple(r) for r in winner(spark, [(2.05, 0.06, 0.05, 0.1), (2.05, 0.06, 0.05, 0.2)])] == [(20, 0)]


def test_start_cell_is_not_a_hit_and_end_cell_is(spark):
    assert winner(spark, [(0.06, 0.05, 0.05, 0.1)]) == []
    assert [r.step for r in winner(spark, [(20.03, 0.05, 0.05, 0.1)])] == [200]
    assert winner(spark, [(20.15, 0.05, 0.05, 0.1)]) == []


def test_hits_lie_on_their_ray_at_their_own_range(spark):
    points = cloud(spark, [(2.05, 0.09, 0.02, 0.25)])
    row = first_hit.sparse_scan(points, ONE_RAY).first()
    distance = math.dist((2.05, 0.09, 0.02), (0.05, 0.05, 0.05))
    assert np.allclose([row.x, row.y, row.z], [0.05 + distance, 0.05, 0.05], atol=1e-6) and row.intensity == 0.25


def test_cloud_without_intensity_reads_as_zero(spark):
    assert first_hit.sparse_scan(cloud(spark, [(2.05, 0.06, 0.05, 0.7)]).drop("intensity"), ONE_RAY).first().intensity == 0.0


def test_empty_cloud_gives_empty_scan(spark):
    assert first_hit.sparse_scan(cloud(spark, [(0.0, 0.0, 0.0, 0.0)]).limit(0), MODELS["scala"]).count() == 0


def test_repeated_points_keep_the_first_ray(spark):
    rows = [("s", 0, "m", r, 1.0, 2.0, 3.0, i) for r, i in ((5, 0.5), (2, 0.2), (9, 0.9))] + [("s", 0, "m", 1, 1.0, 2.0, 3.5, 0.1)]
    scan = spark.createDataFrame(rows, "sequence string, frame_index int, sensor string, ray_id int, x float, y float, z float, intensity float")
    kept = first_hit.distinct_scan_points(scan).orderBy("ray_id").collect()
    assert [(r.ray_id, round(r.intensity, 3)) for r in kept] == [(1, 0.1), (2, 0.2)]


def test_one_crowded_voxel_stays_whole(spark):
    """A third of all points in one voxel of one frame."""
    crowd = spark.range(30_000).select(
        F.lit("s").alias("sequence"), F.lit(0).alias("frame_index"), F.col("id").alias("point_ord"),
        (F.lit(2.01) + (F.col("id") % 80) * 0.001).alias("x"), F.lit(0.06).alias("y"), F.lit(0.05).alias("z"), F.lit(0.5).alias("intensity"),
    )
    best = first_hit.first_hits(crowd, ONE_RAY).collect()
    assert len(best) == 1 and best[0].point_ord == 0
    assert first_hit.ray_candidates(crowd, ONE_RAY).count() == 30_000


def test_plan_has_no_voxel_shuffle_of_points(spark):
    plan = first_hit.sparse_scan(cloud(spark, [(2.05, 0.06, 0.05, 0.7)]), MODELS["scala"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Points and near voxels look up the rays; only points next to a mount meet the first voxels of rays.
    assert plan.count("BroadcastExchange") >= 1 and plan.count("WindowGroupLimit") == 2


def test_near_pairs_of_rays_and_voxels_are_counted_as_numbers(spark):
    """Their grouping hashes whole numbers; a struct would be sorted, with every ray's place in it."""
    cloud = spark.createDataFrame([("s", 0, 1, 4.5, -0.1, 0.35)], "sequence string, frame_index int, point_ord long, x double, y double, z double")
    plan = first_hit.first_hits(cloud, MODELS["scala"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_filters_beside_a_mount_read_coordinates_as_values(spark):
    """Coordinates that are expressions are not worked out anew in each comparison of the near field's boxes."""
    far = cloud(spark, [(20.0, 0.1, 0.3, 0.5)]).withColumns({a: F.cbrt(a) for a in "xyz"})
    plan = first_hit.first_hits(far, MODELS["scala"])._jdf.queryExecution().optimizedPlan().toString()
    counts = [line.count("CBRT(") for line in plan.splitlines() if "Filter " in line]
    assert "CBRT(" in plan and max(counts) <= 3


def test_equal_walks_are_walked_once(spark):
    """Totals of repeated rays, of rays that share an end and of one without cells equal those over every ray's own cells."""
    ends = [(1, 2, 0, 9, 4, -3), (2, 2, 0, 9, 4, -3), (3, 0, 0, 9, 4, -3), (4, 2, 0, -5, 5, 0), (5, 2, 0, 0, 0, 0), (2, 2, 0, 9, 4, -3)]
    rays = spark.createDataFrame([(*e[:3], 7, *e[3:], max(map(abs, e[3:]))) for e in ends], "id int, v0x int, v0y int, v0z int, dx int, dy int, dz int, length int")
    totals = {"n": F.count(F.lit(1)), "last": F.max(F.struct("step", "vx", "vy", "vz")), "sum": F.sum(F.col("vy") * F.col("step"))}
    walks = walked(rays, **totals)
    per_id = ray_cells(rays.distinct()).groupBy("id").agg(*[v.alias(n) for n, v in totals.items()])
    want = {r.id: (r.n, r.last, r["sum"]) for r in per_id.collect()}
    got = [(r.id, (r.n, r.last, r["sum"])) for r in walks.collect()]
    assert sorted(i for i, _ in got) == [1, 2, 2, 3, 4] and all(want[i] == v for i, v in got)
    plan = walks._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert any("Aggregate [v0x" in line for line in plan[explode:])
