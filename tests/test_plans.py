"""Whole jobs on files."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import scanmill
from scanmill.config import MODELS
from scanmill.operators import history, samples, splits
from scanmill.plans.dataset import DEFAULT_OUTPUTS, OUTPUTS, generated_labels, split_keys
from scanmill.sources import checkpoints, readers, runs, schemas, writers
from workbench import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return fx.frames(spark, SF).drop("frame_no"), fx.points(spark, SF).drop("frame_no"), fx.boxes(spark, SF)


def test_whole_dataset_is_written(spark, inputs, tmp_path):
    sequences = spark.createDataFrame([("train", "segment-0000"), ("val", "segment-0001")], "split string, sequence string")
    folders = scanmill.write_dataset(*inputs, MODELS["scala"], sequences, str(tmp_path), outputs=OUTPUTS, selected_sensors=["front_center", "front_right"])
    assert set(folders) == set(OUTPUTS)
    for name in ("points_1f", "points_4f", "images_overlap_height", "labels", "labels_4f"):
        table = spark.read.parquet(folders[name])
        assert {r.split for r in table.select("split").distinct().collect()} == {"training", "validation"}
        assert {r.sensor for r in table.select("sensor").distinct().collect()} == {"front_center", "front_right"}
    assert (tmp_path / "points_1f" / "split=training" / "sensor=front_right").is_dir()
    for horizon, most in (("2f", 2), ("4f", 4)):
        records = spark.read.json(folders[f"gt_{horizon}"])
        assert records.agg(F.max("num_frames")).first()[0] == most
    lines = spark.read.parquet(folders["labels"])
    assert lines.filter("line is null").count() > 0

    writers.write_label_text(lines, str(tmp_path / "text"))
    back = spark.read.text(str(tmp_path / "text")).select(F.split("value", "\t").alias("parts"))
    assert back.count() == lines.select("split", "sensor", "stem").distinct().count()
    assert back.agg(F.sum(F.size("parts") - 1)).first()[0] == lines.filter("line is not null").count()

    stored, stems = generated_labels(spark, str(tmp_path), splits=["training"])
    assert stored.columns == ["split", "sensor", "stem", "line_no", "line"]
    done = scanmill.to_obb_samples(stored, stems)
    assert done.select("split").distinct().collect()[0].split == "training"
    numbers = samples.sample_numbers(samples.parsed_labels(stored), stems)
    totals = samples.samples_per_split(numbers).first()
    assert totals.n_samples == numbers.count() and totals.n_boxes == done.count()
    for row in samples.sample_mapping(numbers).collect():
        assert row.stem == f"{row.sequence}_{row.sensor}_{row.frame_index:03d}"
    writers.write_obb_text(done, str(tmp_path / "obb"))
    assert spark.read.text(str(tmp_path / "obb")).count() == totals.n_samples
    writers.write_manifest(samples.split_manifest(done, "/out"), str(tmp_path / "manifest"))
    paths = [r.value for r in spark.read.text(str(tmp_path / "manifest")).collect()]
    assert sorted(paths)[0] == "/out/images/training/0000000.png" and len(paths) == done.select("sample_index").distinct().count()


@pytest.fixture(scope="module")
def grown(spark, inputs, tmp_path_factory):
    """Training, then validation, then one training sequence again with other points and boxes."""
    root = str(tmp_path_factory.mktemp("grown"))
    outputs = ["points_1f", "labels", "gt_2f", "images_height"]
    write = lambda points, *rows: scanmill.write_dataset(
        inputs[0], points, inputs[2], MODELS["scala"], spark.createDataFrame(list(rows), "split string, sequence string"), root, outputs, ["front_center"]
    )
    states = []
    for points, rows in (
        (inputs[1], [("train", "segment-0000")]), (inputs[1], [("val", "segment-0001")]),
        (inputs[1].filter("frame_index < 4").withColumn("intensity", F.lit(7.0).cast("float")), [("train", "segment-0000")]),
    ):
        write(points, *rows)
        states.append({o: sorted(map(str, runs.read_output(spark, root, o).collect())) for o in outputs})
    return root, outputs, states


def test_a_second_split_leaves_the_first_alone(spark, grown):
    _, outputs, (first, second, _) = grown
    for o in outputs:
        assert first[o] and set(first[o]) < set(second[o]) and all("validation" in r for r in set(second[o]) - set(first[o]))


def test_a_sequence_done_again_replaces_only_its_rows(spark, grown):
    root, outputs, (first, second, third) = grown
    points = runs.read_output(spark, root, "points_1f")
    assert {r[0] for r in points.filter("sequence = 'segment-0000'").select("intensity").distinct().collect()} == {7.0}
    assert points.filter("sequence = 'segment-0000' and frame_index >= 4").count() == 0
    for o in outputs:
        assert {r for r in third[o] if "validation" in r} == {r for r in second[o] if "validation" in r}
    held = spark.read.parquet(f"{root}/points_1f")
    assert held.select("run").distinct().count() == 2, "the first call's rows are gone"
    assert runs.read_output(spark, root, "points_1f", ["validation"]).select("split").distinct().count() == 1


def test_a_call_that_does_not_finish_changes_nothing(spark, grown):
    root, outputs, states = grown
    broken = spark.read.parquet(f"{root}/points_1f").drop("run").withColumn("intensity", F.lit(-1.0).cast("float"))
    runs.write_run(broken, root, "points_1f", runs.new_run())
    assert sorted(map(str, runs.read_output(spark, root, "points_1f").collect())) == states[2]["points_1f"]
    lines, stems = generated_labels(spark, root, splits=["validation"])
    assert lines.count() and {r.split for r in stems.collect()} == {"validation"}


def test_compacting_keeps_what_counts(spark, grown):
    root, outputs, states = grown
    run = runs.compact(spark, root, outputs)
    for o in outputs:
        assert sorted(map(str, runs.read_output(spark, root, o).collect())) == states[2][o]
        assert {r.run for r in runs.finished(spark, root).filter(F.col("output") == o).collect()} == {run}
    assert runs.drop_superseded(spark, root) == sorted(runs.drop_superseded(spark, root))


def test_listings_of_one_name_are_finished_and_redone_on_their_own(spark, inputs, tmp_path):
    """Rows once for each listing, under its split, and from its latest call; rasters once for each split; frames that share a key once."""
    frames, points, boxes = inputs
    root, name, few = str(tmp_path), "segment-0000", ["front_center"]
    outputs = ["points_1f", "images_height", "gt_2f"]
    listed = spark.createDataFrame([("train", name, 1), ("val", name, 2), ("train", name, 3)], "split string, sequence string, listing long")
    scanmill.write_dataset(frames.unionByName(frames), points, boxes, MODELS["scala"], listed, root, outputs, few)
    stronger = points.withColumn("intensity", F.col("intensity") + 1)
    scanmill.write_dataset(frames, stronger, boxes, MODELS["scala"], listed.filter("listing = 3"), root, outputs, few)
    scanmill.write_dataset(frames, points, boxes, MODELS["scala"], spark.createDataFrame([("train", "segment-0001")], "split string, sequence string"), root, outputs, few)

    def counts():
        got = runs.read_output(spark, root, "points_1f").groupBy("sequence", "listing", "split").agg(F.count(F.lit(1)).alias("n"), F.min("intensity").alias("least"))
        return {(r.sequence, r.listing, r.split): (r.n, r.least >= 1) for r in got.collect()}

    first = counts()
    n = first[name, 1, "training"][0]
    assert first.pop(("segment-0001", None, "training"))[0] > 0
    assert first == {(name, 1, "training"): (n, False), (name, 2, "validation"): (n, False), (name, 3, "training"): (n, True)}
    pixels = runs.read_output(spark, root, "images_height")
    assert "listing" not in pixels.columns and pixels.count() == pixels.distinct().count()
    records = runs.read_output(spark, root, "gt_2f").filter(F.col("sequence_name") == name).groupBy("listing").count().collect()
    assert {r.listing for r in records} == {1, 2, 3} and len({r["count"] for r in records}) == 1
    kept = counts()
    runs.compact(spark, root, outputs)
    assert counts() == kept


def test_writers_keep_the_folders_of_other_splits(spark, tmp_path):
    path = str(tmp_path / "lines")
    for split in ("training", "validation"):
        rows = spark.createDataFrame([(split, "front_left", "a_000", 0, "x")], "split string, sensor string, stem string, line_no int, line string")
        writers.write_label_lines(rows, path)
        writers.write_label_text(rows, path + "-text")
    assert readers.read_label_lines(spark, path).count() == 2 and spark.read.text(path + "-text").count() == 2


def test_dense_points_meet_the_split_by_frame(spark, inputs):
    sampled = splits.sampled_split(fx.split_list(spark, SF), fx.frames(spark, SF), data_percent=60.0)
    keys = split_keys(inputs[0], sampled)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = inputs[1].join(keys, ["sequence", "frame_index"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("lineitem")].splitlines()
    joins = [line for line in above if "hashpartitioning(sequence" in line and "frame_index" in line]
    assert joins, "points are dealt by frame"


def test_build_checks_its_outputs(spark, inputs):
    with pytest.raises(ValueError, match="unknown outputs"):
        scanmill.build_dataset(*inputs, MODELS["scala"], outputs=["video"])
    tables = scanmill.build_dataset(*inputs, MODELS["scala"], outputs=["points_1f"], selected_sensors=["front_right"])
    assert list(tables) == ["points_1f"] and "labels_2f" not in DEFAULT_OUTPUTS
    assert [r.sensor for r in tables["points_1f"].select("sensor").distinct().collect()] == ["front_right"]


def test_label_files_and_raster_listing(spark, tmp_path):
    for sensor in ("front_left", "rear_left"):
        for kind, ending, body in (("labels", "txt", "1 2 3 4 5 6 0 Vehicle\n\n1 2 3 4 5 6 7\n"), ("images_height", "png", "x")):
            folder = tmp_path / "training" / sensor / kind
            folder.mkdir(parents=True)
            for i in range(2):
                (folder / f"seq_{sensor}_{i:03d}.{ending}").write_text(body)
    (tmp_path / "training" / "rear_left" / "labels" / "seq_rear_left_002.txt").write_text("")
    with pytest.warns(UserWarning, match="validation"):
        lines = readers.read_label_text(spark, str(tmp_path), ["training", "validation"])
    assert sorted((r.stem, r.line_no) for r in lines.collect())[:3] == [("seq_front_left_000", 0), ("seq_front_left_000", 1), ("seq_front_left_000", 2)]
    with pytest.warns(UserWarning):
        assert readers.list_rasters(spark, str(tmp_path), ["testing"], "height").count() == 0
    images = readers.list_rasters(spark, str(tmp_path), ["training"], "height")
    assert images.count() == 4 and images.columns == ["split", "sensor", "stem"]
    done = scanmill.to_obb_samples(lines, images).orderBy("sample_index").collect()
    assert [(r.sensor, r.stem, r.sample_index) for r in done] == [
        (s, f"seq_{s}_{i:03d}", n) for n, (s, i) in enumerate((s, i) for s in ("front_left", "rear_left") for i in range(2))
    ]
    assert done[0].text.startswith("0 0.029297 0.456055") or len(done[0].text.split()) == 9


def test_split_lists_and_tables(spark, inputs, tmp_path):
    (tmp_path / "train.txt").write_text("a\t\n b \n")
    (tmp_path / "val.txt").write_text("c\n")
    got = {tuple(r) for r in readers.read_split_list(spark, str(tmp_path), ["train", "val"]).collect()}
    assert got == {("train", "a"), ("train", "b"), ("val", "c")}
    with pytest.raises(ValueError):
        readers.read_split_list(spark, str(tmp_path), ["dev"])
    inputs[0].write.parquet(str(tmp_path / "frames"))
    frames = readers.read_table(spark, str(tmp_path / "frames"), "frames")
    assert frames.schema == schemas.FRAMES and frames.count() == 20
    with pytest.raises(ValueError):
        readers.read_table(spark, "x", "cameras")


def test_written_tables_and_checkpoints(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert checkpoints.written(df).agg(F.sum("v")).first()[0] == 90
    assert checkpoints.cut_lineage(df).count() == 10
    assert json.dumps(checkpoints.shared_folder(spark))
    with checkpoints.Scratch(spark) as scratch:
        table = scratch.written(df)
        assert table.count() == 10 and os.path.isdir(scratch.folder.removeprefix("file:"))
    assert not os.path.exists(scratch.folder.removeprefix("file:"))


def test_a_cluster_must_name_its_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.shared_folder(session)


def test_frames_of_one_stamp_need_a_tie_break(spark):
    rows = spark.createDataFrame([("s", 5, 2), ("s", 5, 1), ("s", 3, 9)], "sequence string, timestamp_micros long, record int")
    numbered = {r.record: r.frame_index for r in history.frame_ordinals(rows, ties=["record"]).collect()}
    assert numbered == {9: 0, 1: 1, 2: 2}
    with pytest.raises(Exception, match="without an order"):
        history.frame_ordinals(rows.drop("record")).collect()
