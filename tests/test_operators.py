"""Labels, history, fusion, tracks, rasters, samples and splits on hand-made tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from scanmill.config import BEV, MODELS, Bev, SensorModel, SensorMount
from scanmill.functions import boxes as box_fn
from scanmill.operators import box_filter, fusion, history, labels, range_image, rasters, samples, sensor_frame, splits
from scanmill.operators import raster_tiles, tracks, voxel_groups
from scanmill.sources import checkpoints

RIG = SensorModel("rig", (SensorMount("m", 0.0, 0.0, 0.0, 0.0),), 80.0, -72.5, 72.5, (0.0,), azimuth_steps=580)
SCAN = "sequence string, frame_index int, sensor string, ray_id int, x float, y float, z float, intensity float"
BOX = (
    "sequence string, frame_index int, box_ord int, cx double, cy double, cz double, length double, width double,"
    " height double, heading double, type int, track_id string"
)
EYE = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def scan_of(spark, rows):
    return spark.createDataFrame(rows, SCAN)


def frames_of(spark, stamps, shift=1.0):
    rows = [("s", i, int(t), [float(v) for v in EYE[:3]] + [shift * i] + [float(v) for v in EYE[4:]]) for i, t in stamps]
    return spark.createDataFrame(rows, "sequence string, frame_index int, timestamp_micros long, pose array<double>")


def ring(frame, x, n, y=0.0):
    return [("s", frame, "m", i, x + 0.01 * i, y, 0.0, 0.1) for i in range(n)]


def test_box_needs_four_points_in_view(spark):
    scan = scan_of(spark, ring(0, 10.0, 4) + ring(1, 10.0, 3))
    boxes = spark.createDataFrame(
        [("s", f, 0, 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.3, 1, "a") for f in (0, 1)]
        + [("s", 0, 1, -10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 1, "behind"), ("s", 0, 2, 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 3, "sign")], BOX)
    kept = box_filter.kept_boxes(scan, boxes, RIG).collect()
    assert [(r.frame_index, r.box_ord, r.num_points_scan, r.colour) for r in kept] == [(0, 0, 4, [0.0, 1.0, 0.0])]
    loose = box_filter.kept_boxes(scan, boxes, RIG, threshold=0)
    assert {(r.frame_index, r.box_ord) for r in loose.collect()} == {(0, 0), (1, 0)}


def test_box_of_any_size_counts_every_point_once(spark):
    scan = scan_of(spark, [("s", 0, "m", i, float(i % 70) + 0.5, float(i % 31) - 15.0, 0.0, 0.0) for i in range(500)])
    boxes = spark.createDataFrame([("s", 0, 0, 5.0, 0.0, 0.0, 1e6, 1e6, 10.0, 0.4, 1, "sky"), ("s", 0, 1, 40.0, 2.0, 0.0, 25.0, 3.0, 3.0, 1.1, 1, "bus")], BOX)
    counts = {r.box_ord: r.n for r in box_filter.box_point_counts(scan, box_filter.boxes_in_view(boxes, RIG), RIG).collect()}
    c, s = math.cos(1.1), math.sin(1.1)
    inside = 0
    for i in range(500):
        dx, dy = float(i % 70) + 0.5 - 40.0, float(i % 31) - 15.0 - 2.0
        inside += abs(c * dx + s * dy) <= 12.5 and abs(-s * dx + c * dy) <= 1.5
    assert counts[0] == 500 and counts.get(1, 0) == inside > 0


def test_boxes_are_never_broadcast(spark):
    """Small tables in files: unfolded over mounts and tiles, boxes are many more than their files let expect."""
    scan = checkpoints.written(scan_of(spark, ring(0, 10.0, 4)))
    boxes = checkpoints.written(spark.createDataFrame([("s", 0, 0, 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.3, 1, "a")], BOX))
    kept = box_filter.kept_boxes(scan, boxes, RIG)
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "ShuffledHashJoin" in plan


def test_corners_of_equal_lines_are_ordered_together(spark):
    """Angles of all corners, so that boxes which share a line can be merged by them."""
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 1), (-1, 1), (-1, -1), (1, -1))])
    ordered = spark.range(1).select(F.inline(box_fn.corner_angles(square))).collect()
    assert [(r.p.x, r.p.y) for r in ordered] == [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    assert [round(r.angle / (math.pi / 4)) for r in ordered] == [-3, -1, 1, 3]


def test_view_is_about_the_centre_only_and_wraps(spark):
    rig = SensorModel("r", (SensorMount("back", 0.0, 0.0, 0.0, 180.0),), 80.0, -72.5, 72.5, (0.0,), azimuth_steps=2)
    boxes = spark.createDataFrame(
        [("s", 0, i, 10 * math.cos(math.radians(b)), 10 * math.sin(math.radians(b)), 0.0, 1.0, 1.0, 1.0, 0.0, 1, str(b))
         for i, b in enumerate((179, -179, 108, -108, 107, 0))], BOX)
    assert sorted(r.track_id for r in box_filter.boxes_in_view(boxes, rig).collect()) == ["-108", "-179", "108", "179"]


def test_half_of_an_inverted_view_gets_a_turn():
    assert SensorModel("r", (), 1.0, 170.0, -170.0, (0.0,)).half_fov == 190.0


def test_history_counts_non_empty_scans(spark):
    scans = spark.createDataFrame([("s", "m", f) for f in (0, 2, 3, 7, 8)] + [("t", "m", 0), ("s", "n", 3)], "sequence string, sensor string, frame_index int")
    pairs = {(r.frame_index, r.k): r.source_frame for r in history.history_pairs(scans).filter("sequence = 's' and sensor = 'm'").collect()}
    assert pairs == {
        (0, 0): 0, (2, 0): 2, (2, 1): 0, (3, 0): 3, (3, 1): 2, (3, 2): 0,
        (7, 0): 7, (7, 1): 3, (7, 2): 2, (7, 3): 0, (8, 0): 8, (8, 1): 7, (8, 2): 3, (8, 3): 2,
    }
    assert history.history_pairs(scans).filter("sequence = 't'").count() == 1


def test_ranks_run_on_across_chunks(spark):
    rows = spark.createDataFrame([("g", i * 3) for i in range(50)] + [("h", 7)], "g string, o int")
    ranked = history.rank_in_group(rows, ["g"], "o", chunk=8)
    assert {(r.g, r.o): r["rank"] for r in ranked.collect()} == {**{("g", i * 3): i + 1 for i in range(50)}, ("h", 7): 1}


def test_frame_ordinals_follow_time(spark):
    rows = spark.createDataFrame([("s", 30), ("s", 10), ("s", 20), ("t", 5)], "sequence string, timestamp_micros long")
    got = {(r.sequence, r.timestamp_micros): r.frame_index for r in history.frame_ordinals(rows, 15).collect()}
    assert got == {("s", 10): 0, ("s", 20): 1, ("s", 30): 2, ("t", 5): 0}


def test_time_horizon():
    assert fusion.time_horizon_micros(4) == 3e5 and fusion.time_horizon_micros(1) == 1.0
    assert fusion.time_horizon_micros(4, fixed_horizon_s=0.5) == 5e5 and fusion.time_horizon_micros(2, fixed_horizon_s=0) == 1.0
    for bad in ({"num_frames": 0}, {"num_frames": 2, "frame_rate_hz": 0}):
        with pytest.raises(ValueError):
            fusion.time_horizon_micros(**bad)


def test_fused_cloud_saturates_across_a_gap(spark):
    scan = scan_of(spark, ring(0, 10.0, 1) + ring(5, 10.0, 1))
    frames = frames_of(spark, [(0, 0), (5, 500_000)])
    fused = {r.k: r for r in fusion.fuse_frames(scan, frames, RIG, 2).collect() if r.frame_index == 5}
    assert fused[0].dt_norm == 0.0 and fused[1].dt_norm == -1.0
    assert math.isclose(fused[0].x - fused[1].x, 5.0, abs_tol=1e-5)
    free = fusion.fuse_frames(scan, frames, RIG, 2, clip=None).filter("k = 1").first()
    assert free.dt_norm == -5.0
    assert fusion.fuse_frames(scan, frames, RIG, 1).count() == 2


def test_padding_replaces_the_mount_on_x(spark):
    rig = SensorModel("r", (SensorMount("m", 3.5, 0.5, 0.25, 90.0),), 80.0, -72.5, 72.5, (0.0,), azimuth_steps=2)
    scan = scan_of(spark, [("s", 0, "m", 0, 1.0, 2.0, 3.0, 0.5)])
    padded, plain = (sensor_frame.scan_to_sensor(scan, rig, padded=p).first() for p in (True, False))
    assert [round(v, 5) for v in (padded.x, padded.y, padded.z)] == [1.5, round(-(1.0 - 0.2), 5), 2.75]
    assert [round(v, 5) for v in (plain.x, plain.y, plain.z)] == [1.5, 2.5, 2.75]


def label_table(spark, scan, boxes):
    return labels.label_rows(box_filter.kept_boxes(scan, boxes, RIG, threshold=1), RIG)


def test_track_records_nest_and_keep_empty_slots(spark):
    scan = scan_of(spark, ring(0, 10.0, 4) + ring(1, 30.0, 2) + ring(2, 10.0, 4))
    boxes = spark.createDataFrame([("s", f, b, 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 3.1, 1, None if b else "t") for f in (0, 2) for b in (1, 0)], BOX)
    rows = tracks.track_boxes(label_table(spark, scan, boxes), labels.non_empty_scans(scan), frames_of(spark, [(0, 0), (1, 1), (2, 2)]), RIG, 4)
    documents = {d["frame_index"]: d for d in map(json.loads, tracks.track_records(rows).toJSON().collect())}
    assert [(f["frame_id"], [a["track_id"] for a in f["annos"]]) for f in documents[2]["frames"]] == [(0, ["t", ""]), (1, []), (2, ["t", ""])]
    assert documents[2]["num_frames"] == 3 and documents[1]["frames"][0] == {"frame_id": 0, "annos": []}
    moved = documents[2]["frames"][2]["annos"][0]
    assert math.isclose(moved["location"][0], 10.0 - 2.0 - BEV.padding) and moved["name"] == "Vehicle" and moved["dimensions"] == [2.0, 2.0, 2.0]


def test_scan_without_boxes_keeps_an_empty_label(spark):
    scan = scan_of(spark, ring(0, 10.0, 4) + ring(1, 30.0, 2))
    boxes = spark.createDataFrame([("s", 0, 0, 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 4, "t")], BOX)
    lines = {r.stem: r.line for r in labels.label_lines(label_table(spark, scan, boxes), labels.non_empty_scans(scan)).collect()}
    assert lines["s_m_000"].endswith("2.000000 2.000000 2.000000 0.000000 Cyclist") and lines["s_m_001"] is None


def test_last_point_paints_and_discs_are_clipped(spark):
    x = BEV.padding + 0.05
    scan = scan_of(spark, [("s", 0, "m", 0, x, 0.05, -1.0, 0.0), ("s", 0, "m", 1, x, 0.05, 2.0, 0.0)])
    cells = {(r.px, r.py): (r.b, r.g, r.r) for r in rasters.raster(scan, frames_of(spark, [(0, 0)]), RIG, "height").collect()}
    assert cells == {p: (0, 0, 255) for p in ((0, 511), (1, 511), (0, 510), (0, 512))}
    with pytest.raises(ValueError):
        rasters.raster(scan, scan, RIG, "colour")


def test_overlap_uses_the_last_non_empty_scan(spark):
    x = BEV.padding + 20.05
    scan = scan_of(spark, [("s", f, "m", 0, x, 0.05, 0.5, 0.0) for f in (0, 4)])
    frames = frames_of(spark, [(f, f) for f in range(5)])
    for method, value in (("overlap", 255), ("overlap_height", 127)):
        cells = {(r.frame_index, r.px, r.py): (r.b, r.g, r.r) for r in rasters.raster(scan, frames, RIG, method).collect()}
        assert cells[(0, 200, 511)] == (0, value, 0) and cells[(4, 200, 511)] == (0, value, 0)
        assert cells[(4, 160, 511)] == (0, 0, value) and len(cells) == 15


def test_motions_that_lead_far_from_the_plane_are_left_out(spark):
    """Two frames share a key a kilometre apart: of four motions two stay."""
    scan = scan_of(spark, [("s", f, "m", i, 10.0 + i, 0.0, 0.0, 0.1) for f in (0, 1) for i in range(3)])
    pose = lambda x: [float(v) for v in EYE[:3]] + [x] + [float(v) for v in EYE[4:]]
    frames = spark.createDataFrame([("s", f, f * 100_000, pose(x)) for f in (0, 1) for x in (0.0, 1000.0)],
                                   "sequence string, frame_index int, timestamp_micros long, pose array<double>")
    assert rasters.previous_in_current(scan, frames, RIG).count() == 12
    assert rasters.previous_in_current(scan, frames, RIG, origin="edge").count() == 6


def test_pixels_are_worked_out_before_they_are_filtered(spark):
    """The bounds of the plane compare whole pixels; the turn into the sensor's frame is not repeated in each comparison."""
    painted = rasters.raster(scan_of(spark, ring(0, 10.0, 4)), frames_of(spark, [(0, 0)]), RIG, "height")
    plan = painted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("rint(" in line for line in plan) and not [line for line in plan if "Filter " in line and "rint(" in line]


def test_tiles_give_their_columns_to_their_pixels(spark):
    pixels = spark.createDataFrame([("s", 0, "m", x, y, 1, 2, 3) for x, y in ((3, 0), (4, 0), (7, 9), (0, 1023))],
                                   "sequence string, frame_index int, sensor string, px int, py int, b short, g short, r short")
    packed = raster_tiles.raster_tiles(pixels)
    rows = raster_tiles.tile_pixels(packed, "n_pixels", F.hex("occupied").alias("occupied")).collect()
    assert sorted((r.px, r.py) for r in rows) == [(0, 1023), (3, 0), (4, 0), (7, 9)]
    assert {(r.n_pixels, r.occupied) for r in rows} == {(4, "8040" + "00" * 125 + "01")}


def test_previous_scan_keeps_values_where_both_paint(spark):
    scan = scan_of(spark, [("s", f, "m", 0, BEV.padding + 20.05 - f, 0.05, 0.5 * f, 0.0) for f in (0, 1)])
    cells = {(r.px, r.py): (r.g, r.r) for r in rasters.raster(scan, frames_of(spark, [(0, 0), (1, 1)]), RIG, "overlap_height").filter("frame_index = 1").collect()}
    assert cells[(190, 511)] == (127, 85)


def test_voxel_representatives(spark):
    rows = [("s", 0, 0, 0.01, 0.05, 0.05, 9.0), ("s", 0, 1, 0.05, 0.04, 0.05, 8.0), ("s", 0, 2, 0.05, 0.06, 0.05, 7.0), ("s", 0, 3, 0.15, 0.05, 0.05, 6.0)]
    points = spark.createDataFrame(rows, "sequence string, frame_index int, point_ord long, x double, y double, z double, intensity double")
    assert {(r.vx, r.point_ord) for r in voxel_groups.voxel_nearest(points).collect()} == {(0, 1), (1, 3)}
    mean = voxel_groups.voxel_centroids(points).filter("vx = 0").first()
    assert mean.n == 3 and math.isclose(mean.x, 0.11 / 3) and math.isclose(mean.y, 0.05)


def test_range_pixels_follow_mask_and_order(spark):
    data = [10.0, 0.5, 0.0, -1.0, 0.0, 0.6, 0.0, -1.0, 5.0, 0.7, 0.0, 1.0, 20.0, 0.8, 0.0, -1.0]
    images = spark.createDataFrame([("s", 0, 2, 1, 2, 2, 4, data), ("s", 0, 2, 0, 2, 2, 4, data), ("s", 0, 9, 0, 2, 2, 4, data)],
                                   "sequence string, frame_index int, laser int, ret int, height int, width int, channels int, data array<float>")
    cal = spark.createDataFrame([(2, [0.1, 0.2], 0.0, 0.0, EYE), (9, [0.1, 0.2], 0.0, 0.0, EYE)],
                                "laser int, inclinations array<double>, incl_min double, incl_max double, extrinsic array<double>")
    pixels = range_image.range_image_points(images, cal)
    dense = range_image.dense_points(pixels).orderBy("point_ord").collect()
    assert [round(r.intensity, 2) for r in dense] == [0.5, 0.8, 0.5, 0.8]
    first = pixels.filter("ret = 0 and idx = 0").first()
    az, inc = (0.75 * 2 - 1) * math.pi, 0.2
    assert math.isclose(first.x, 10 * math.cos(inc) * math.cos(az), abs_tol=1e-5) and math.isclose(first.z, 10 * math.sin(inc), abs_tol=1e-5)
    everything = range_image.range_image_points(images, cal, drop_no_label_zone=False)
    assert everything.count() == 6


def test_split_sampling_draws_before_the_existence_test(spark):
    listed = spark.createDataFrame([("train", f" n{i} ") for i in range(100)] + [("val", "v0")], "split string, sequence string")
    some = spark.createDataFrame([(f"n{i}",) for i in range(0, 100, 2)], "sequence string")
    everything = spark.createDataFrame([(f"n{i}",) for i in range(100)] + [("v0",)], "sequence string")
    full = splits.sampled_split(listed, everything, 33.4)
    assert {(r.split, r["n"]) for r in full.groupBy("split").agg(F.count("*").alias("n")).collect()} == {("train", 33)}
    drawn = {r.sequence for r in full.collect()}
    assert {r.sequence for r in splits.sampled_split(listed, some, 33.4).collect()} == {n for n in drawn if int(n[1:]) % 2 == 0}
    assert {r.sequence for r in splits.sampled_split(listed, everything, 33.4, seed="1").collect()} != drawn
    with pytest.raises(ValueError):
        splits.check_split("dev")


def test_a_name_listed_again_is_left_over_as_often_as_it_was_not_drawn(spark):
    listed = spark.createDataFrame([("train", "a"), ("train", "a"), ("train", "a"), ("train", "b")], "split string, sequence string")
    drawn = spark.createDataFrame([("train", "a")], "split string, sequence string")
    assert sorted(r.sequence for r in splits.left_over(drawn, listed).collect()) == ["a", "a", "b"]


def test_sensor_requests():
    assert splits.requested_sensors(["all"]) == sorted(splits.SENSOR_NAMES)
    assert splits.requested_sensors(["rear_left", "front_left"]) == ["rear_left", "front_left"]
    with pytest.raises(ValueError, match="roof"):
        splits.requested_sensors(["roof", "front_left"])


def test_samples_are_numbered_without_gaps(spark):
    good, bad = "1 2 3 4 5 6 0 Vehicle", "1 2 3 4 5 6 0 Tram"
    rows = [("training", s, f"q{i}_{s}_{i:03d}", 0, bad if i == 3 else good) for s in ("front_left", "rear_left") for i in range(30)]
    lines = spark.createDataFrame(rows, "split string, sensor string, stem string, line_no int, line string")
    images = lines.filter(~F.col("stem").endswith("_005")).select("split", "sensor", "stem")
    numbers = samples.sample_numbers(samples.parsed_labels(lines), images, ["rear_left", "front_left"]).orderBy("sample_index").collect()
    assert [r.sample_index for r in numbers] == list(range(56))
    stems = [(r.sensor, r.stem) for r in numbers]
    assert stems == sorted(stems, key=lambda t: (t[0] != "rear_left", t[1]))
    assert [r.sensor for r in numbers][:28] == ["rear_left"] * 28


def test_only_mounts_of_the_model_are_kept(spark):
    scan = scan_of(spark, [("s", 0, n, 0, 1.0, 1.0, 1.0, 0.0) for n in ("front_left", "roof")])
    assert [r.sensor for r in sensor_frame.points_single(scan, MODELS["scala"]).collect()] == ["front_left"]


# ---------------------------------------------------------------- whole rasters


def test_tiles_give_their_pixels_and_images_back(spark):
    bev = Bev(x_size=24, y_size=20)
    rng = random.Random(3)
    pixels = []
    for frame in range(3):
        cells = {(rng.randrange(24), rng.choice([0, 3, 4, 19])) for _ in range(40)}
        cells |= {(x, 7) for x in range(24)}
        pixels += [("s", frame, "front_center", x, y, 0, rng.choice([0, 255]), rng.choice([7, 200]) if y != 7 else 9) for x, y in cells]
    table = spark.createDataFrame(pixels, "sequence string, frame_index int, sensor string, px int, py int, b short, g short, r short")
    packed = checkpoints.written(raster_tiles.raster_tiles(table.withColumn("runs", F.lit("clash")), bev))
    back = raster_tiles.tile_pixels(packed)
    assert back.columns == table.columns and sorted(map(tuple, back.collect())) == sorted(pixels)
    images = {r.frame_index: r.image for r in raster_tiles.tile_images(packed, bev).collect()}
    for row in packed.collect():
        own = {(p[3], p[4]): bytes(p[5:]) for p in pixels if p[1] == row.frame_index}
        assert row.n_pixels == len(own) and [t.py for t in row.lines] == sorted({y for _, y in own})
        bits = "".join(f"{b:08b}" for b in row.occupied)
        assert [i for i, bit in enumerate(bits) if bit == "1"] == sorted({y for _, y in own})
        assert images[row.frame_index] == b"".join(own.get((x, y), bytes(3)) for y in range(20) for x in range(24))
        for line in row.lines:
            assert all(a.px + a.length < b.px or (a.b, a.g, a.r) != (b.b, b.g, b.r) for a, b in zip(line.runs, line.runs[1:]))
    assert raster_tiles.raster_tiles(table.limit(0), bev).count() == 0
