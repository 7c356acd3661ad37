"""Column expressions against plain arithmetic."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanmill.config import Bev
from scanmill.functions import angles, bev, boxes, poses, text, voxels


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_angles_stay_in_the_half_open_turn(spark):
    values = [-math.pi, math.pi, 3 * math.pi, -3 * math.pi, 0.0, 7.5, -12.25]
    rows = spark.createDataFrame([(v,) for v in values], "a double").select(
        angles.angle_difference(F.col("a"), F.lit(0.0)).alias("d"), angles.wrap_to_pi(F.col("a")).alias("w"), "a"
    ).collect()
    for row in rows:
        assert -math.pi <= row.d < math.pi and -math.pi <= row.w < math.pi
        assert math.isclose(math.cos(row.d), math.cos(row.a), abs_tol=1e-9)
        assert math.isclose(row.d, row.w, abs_tol=1e-9)


def test_planar_difference_undoes_place(spark):
    a, b = tuple(lits(3.0, -2.0, 0.7)), tuple(lits(1.0, 5.0, -0.4))
    d = angles.planar_difference(a, b)
    x, y = angles.place_xy(b, d[0], d[1])
    got = one(spark, x, y, d[2])
    assert np.allclose(got, [3.0, -2.0, 1.1])


def pose_matrix(x, y, z, yaw, pitch):
    cy, sy, cp, sp = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    return np.array([[cy * cp, -sy, cy * sp, x], [sy * cp, cy, sy * sp, y], [-sp, 0, cp, z], [0, 0, 0, 1.0]])


def as_motion(matrix):
    return poses.motion_of(F.array(*lits(*matrix.flatten().tolist())))


@pytest.mark.parametrize("convention", poses.POSE_CONVENTIONS)
def test_relative_motion_equals_matrix_product(spark, convention):
    p, c = pose_matrix(100.0, -20.0, 0.3, 0.4, 0.02), pose_matrix(101.5, -19.8, 0.31, 0.45, 0.01)
    want = np.linalg.inv(c) @ p if convention == "vehicle_to_world" else c @ np.linalg.inv(p)
    m = poses.relative_motion(as_motion(p), as_motion(c), convention)
    got = one(spark, *[m[f] for f in poses.MOTION_FIELDS])
    assert np.allclose(got, [*want[:3, :3].flatten(), *want[:3, 3]], atol=1e-9)
    whole = poses.into_sensor(m, *lits(0.4, -0.2, 0.5, 0.9))
    moved = poses.apply_motion(whole, *lits(1.0, 2.0, 3.0))
    step = poses.to_sensor_xyz(*poses.apply_motion(m, *lits(1.0, 2.0, 3.0)), *lits(0.4, -0.2, 0.5, 0.9))
    assert np.allclose(one(spark, *moved), one(spark, *step), atol=1e-9)


def test_unknown_convention_is_refused():
    with pytest.raises(ValueError):
        poses.relative_motion({}, {}, "sideways")


def test_pose_that_scales_is_an_error(spark):
    bad = pose_matrix(0, 0, 0, 0.1, 0.0)
    bad[:3, :3] *= 1.1
    with pytest.raises(Exception, match="rigid"):
        one(spark, poses.rigid_pose(F.array(*lits(*bad.flatten().tolist()))))


def test_inverse_of_a_motion(spark):
    m = as_motion(pose_matrix(5.0, 6.0, 7.0, 0.3, 0.1))
    same = poses.compose(poses.inverse(m), m)
    assert np.allclose(one(spark, *[same[f] for f in poses.MOTION_FIELDS]), [1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0], atol=1e-12)


def test_sensor_planar_motion_equals_the_chain_of_frames(spark):
    vehicle, tx, ty, yaw = (1.2, -0.3, 0.08), 0.4, -0.15, 1.1
    motion = poses.sensor_planar_motion(tuple(lits(*vehicle)), *lits(tx, ty, yaw))
    got = one(spark, *angles.place_xy(motion, *lits(7.0, -3.0)))

    def rot(a):
        return np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])

    in_vehicle = rot(yaw) @ [7.0, -3.0] + [tx, ty]
    moved = rot(vehicle[2]) @ in_vehicle + vehicle[:2]
    assert np.allclose(got, rot(-yaw) @ (moved - [tx, ty]), atol=1e-12)


def test_plane_keeps_its_points_and_faces_up(spark):
    shift = lits(0.09, -0.154, 0.338, 0.5)
    plane = poses.plane_to_sensor(*lits(0.1, 0.2, -1.0, 0.4), *shift)
    point = poses.to_sensor_xyz(*lits(1.0, 2.0, 0.9), *shift)
    a, b, c, d, x, y, z = one(spark, *plane, *point)
    assert abs(a * x + b * y + c * z + d) < 1e-12 and c > 0 and math.isclose(a * a + b * b + c * c, 1.0)
    raw = one(spark, *poses.plane_to_sensor(*lits(0.0, 0.0, 0.0, 0.4), *shift))
    assert raw == (0.0, 0.0, 0.0, 0.4)


def slow_walk(delta):
    """Error-accumulating integer walk, one cell at a time."""
    sizes = [abs(d) for d in delta]
    lead = max(range(3), key=lambda i: (sizes[i], -i))
    total = sizes[lead]
    at, error, cells = [0, 0, 0], [2 * s - total for s in sizes], []
    for _ in range(total):
        for i in range(3):
            if i == lead:
                at[i] += 1 if delta[i] > 0 else -1
                continue
            if error[i] >= 0:
                at[i] += 1 if delta[i] > 0 else -1
                error[i] -= 2 * total
            error[i] += 2 * sizes[i]
        cells.append(tuple(at))
    return cells


def test_closed_form_walk_equals_the_loop(spark):
    rng = random.Random(7)
    deltas = [tuple(rng.randint(-40, 40) for _ in range(3)) for _ in range(400)]
    deltas += [(0, 0, 0), (5, 0, 0), (0, -5, 0), (0, 0, 5), (4, 4, 4), (-6, 6, 0), (3, -3, 2), (0, 7, -7)]
    rays = spark.createDataFrame([(i, *d) for i, d in enumerate(deltas)], "id int, dx int, dy int, dz int")
    length = voxels.walk_length(F.col("dx"), F.col("dy"), F.col("dz"))
    cells = rays.withColumn("length", length).withColumn("step", F.explode(voxels.walk_steps(F.col("length"))))
    rows = cells.select(
        "id", "step", *[voxels.walk_cell(F.col(f"d{a}"), F.col("length"), F.col("step")).alias(a) for a in "xyz"]
    ).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.step)):
        got.setdefault(r.id, []).append((r.x, r.y, r.z))
    assert [got.get(i, []) for i in range(len(deltas))] == [slow_walk(d) for d in deltas]


def test_single_precision_grid(spark):
    values = np.concatenate([np.arange(-50, 50) * 0.1, np.random.default_rng(3).uniform(-90, 90, 500)]).astype(np.float32)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select(
        voxels.voxel_index(F.col("v"), 0.1, "float").alias("f"), voxels.voxel_index(F.col("v"), 0.1).alias("d")
    ).collect()
    assert [r.f for r in rows] == np.floor(values / np.float32(0.1)).astype(int).tolist()
    assert [r.d for r in rows] == np.floor(values.astype(float) / 0.1).astype(int).tolist()
    with pytest.raises(ValueError):
        voxels.voxel_index(F.lit(1.0), 0.1, "half")


def test_box_rotations(spark):
    h = 0.6
    c, s = math.cos(h), math.sin(h)
    args = lits(1.0, 2.0, 3.0, h)
    assert np.allclose(one(spark, *boxes.into_box_frame(*args)), [c + 2 * s, -s + 2 * c, 3])
    assert np.allclose(one(spark, *boxes.into_box_frame(*args, "forward_yaw")), [c - 2 * s, s + 2 * c, 3])
    assert np.allclose(one(spark, *boxes.into_box_frame(*args, "pinned")), [1, 2 * c - 3 * s, 2 * s + 3 * c])
    with pytest.raises(ValueError):
        boxes.into_box_frame(*args, "other")


def test_box_bounds_are_inclusive(spark):
    dims = tuple(lits(2.0, 2.0, 2.0))
    inside = boxes.inside_box(tuple(lits(1.0, -1.0, 1.0)), dims)
    outside = boxes.inside_box(tuple(lits(1.0, -1.0, 1.0000001)), dims)
    assert one(spark, inside, outside) == (True, False)


def test_names_numbers_colours(spark):
    got = one(spark, *[boxes.class_name(F.lit(t)) for t in (1, 2, 3, 4)], boxes.class_id(F.lit("Cyclist")),
              boxes.class_id(F.lit("Unknown")), boxes.box_colour(F.lit(2)))
    assert got == ("Vehicle", "Pedestrian", "Unknown", "Cyclist", 2, None, [0.0, 0.0, 1.0])


def test_pixels_are_cut_towards_zero(spark):
    plane = Bev()
    got = one(spark, *bev.pixel(*lits(-0.05, 0.0), plane), *bev.pixel(*lits(12.39, -3.11), plane),
              *bev.pixel(*lits(1.0, 0.0), plane, "center"))
    assert got == (0, 512, 123, 543, 522, 512)
    with pytest.raises(ValueError):
        bev.pixel(*lits(0.0, 0.0), plane, "corner")


def test_heights_are_clipped(spark):
    plane = Bev()
    values = [bev.channel(bev.height_fraction(F.lit(z), plane)) for z in (-5.0, -1.0, 0.5, 2.0, 9.0)]
    assert one(spark, *values) == (0, 0, 127, 255, 255)


def test_plane_bounds_follow_rows_and_columns(spark):
    plane = Bev(x_size=10, y_size=20)
    got = one(spark, *[bev.in_plane(*lits(px, py), plane) for px, py in ((19, 9), (20, 9), (19, 10), (-1, 0))])
    assert got == (True, False, False, False)


def test_six_decimals_are_rounded_in_doubles(spark):
    """Halves whose shortest decimal form lies on the other side, as x / 102.4 gives them."""
    values = (0.16615749999999999, 0.5200075, -0.2594875, 2.5e9, math.inf)
    got = one(spark, *text.six_decimals(*lits(*values)))
    assert got == (0.166158, 0.520007, -0.259487, 2.5e9, math.inf)


def test_label_line_text(spark):
    line = text.label_line(*lits(20.08072, -4.460201, 0.926611, 1.144897, 1.002529, 1.76, -0.0000001, "Pedestrian"))
    stem = text.frame_stem(*lits("seq", "front_left", 7))
    got = one(spark, line, stem, text.sample_stem(F.lit(42)))
    assert got == ("20.080720 -4.460201 0.926611 1.144897 1.002529 1.760000 0.000000 Pedestrian", "seq_front_left_007", "0000042")


@pytest.mark.parametrize(
    "line, want",
    [
        ("20.080720 -4.460201 0.926611 1.144897 1.002529 1.760000 0.029969 Pedestrian", (1, 20.08072, -4.460201, 1.144897, 1.002529, 0.029969)),
        ("  1 2\t3 4 5 6   7 Vehicle ", (0, 1.0, 2.0, 4.0, 5.0, 7.0)),
        ("1e1 .5 3. 4 5 6 -7 Cyclist", (2, 10.0, 0.5, 4.0, 5.0, -7.0)),
        ("1 2 3 4 5 6 7", None),
        ("1 2 3 4 5 6 7 Vehicle extra", None),
        ("", None),
    ],
)
def test_label_parsing(spark, line, want):
    got = one(spark, text.parse_label(F.lit(line)))[0]
    assert (tuple(got) if got is not None else None) == want


def test_unknown_class_is_no_class_but_its_numbers_are_read(spark):
    assert one(spark, text.parse_label(F.lit("1 2 3 4 5 6 7 Tram")))[0].class_id is None
    for bad in ("1 2 x 4 5 6 7 Tram", "1 2 3 4 5 6d 7 Vehicle"):
        with pytest.raises(Exception, match="bad number"):
            one(spark, text.parse_label(F.lit(bad))["class_id"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-50, 50), st.floats(-50, 50), st.floats(0.1, 20), st.floats(0.1, 5), st.floats(-7, 7))
def test_corners_are_a_rectangle(spark, x, y, length, width, heading):
    corners = [v for p in boxes.box_corners(*lits(x, y, length, width, heading)) for v in p]
    p = np.array(one(spark, *corners)).reshape(4, 2)
    assert np.allclose(p.mean(axis=0), [x, y], atol=1e-9)
    assert math.isclose(np.hypot(*(p[0] - p[1])), length, rel_tol=1e-9)
    assert math.isclose(np.hypot(*(p[1] - p[2])), width, rel_tol=1e-9)
