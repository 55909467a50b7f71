"""Sinks by round trip; shapes and skeletons by small cases that can be worked out by hand."""

import math

from orrery.operators import boxes, poses, shapes
from orrery.sources import sinks


def test_arms_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "arms")
    sinks.write_arms(spark.createDataFrame([("a", 1), ("b", 2)], "arm string, v int"), path, "arm")
    sinks.write_arms(spark.createDataFrame([("b", 3)], "arm string, v int"), path, "arm")
    assert sorted((r["arm"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_logs_grow(spark, tmp_path):
    for at, (write, read) in enumerate([(sinks.append_lines, spark.read.json), (sinks.append_csv, lambda p: spark.read.csv(p, header=True, inferSchema=True))]):
        path = str(tmp_path / str(at))
        for v in (1, 2):
            write(spark.createDataFrame([("run, one", v)], "name string, v int").coalesce(1), path)
        assert sorted((r["name"], r["v"]) for r in read(path).collect()) == [("run, one", 1), ("run, one", 2)]


def test_every_path_begins_at_the_root():
    for joint in range(17):
        bones = poses.path(joint)
        assert bones[0][1] == 17 and bones[-1][0] == joint
        assert all(a[0] == b[1] for a, b in zip(bones, bones[1:], strict=False))


def test_virtual_joints_need_both_of_theirs(spark):
    rows = [(0, 0, 11, 0.0, 0.0), (0, 0, 12, 4.0, 2.0), (0, 0, 5, 1.0, 1.0)]
    (r,) = poses.bodies(spark.createDataFrame(rows, "clip long, frame int, joint int, x double, y double")).selectExpr("m[17] AS hips", "m[18] AS neck").collect()
    assert tuple(r["hips"]) == (2.0, 1.0) and tuple(r["neck"]) == (None, None)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "clip long, frame int, joint int, x double, y double")
    assert poses.bodies(none).count() == 0 and poses.swung(none).count() == 0
    assert shapes.boxes_of(spark.createDataFrame([], "frame int, y int, x int")).count() == 0


def test_swing_is_about_the_mean(spark):
    rows = [(0, f, 9, x, 0.0) for f, x in enumerate((0.0, 10.0, 20.0))] + [(0, f, 5, float(f), 0.0) for f in range(3)]
    got = {(r["joint"], r["frame"]): r["nx"] for r in poses.swung(spark.createDataFrame(rows, "clip long, frame int, joint int, x double, y double")).collect()}
    assert [got[9, f] for f in range(3)] == [-3.0, 10.0, 23.0] and all(math.isclose(got[5, f], f) for f in range(3))


def test_tiles_cover_frames_of_any_size(spark):
    got = boxes.tiles(spark.createDataFrame([(1, 2000.0, 300.0), (2, 100.0, 100.0)], "frame long, x2 double, y2 double")).collect()
    wide = {(r["x"], r["y"]) for r in got if r["frame"] == 1}
    assert all(any(x <= px < x + 256 and y <= py < y + 256 for x, y in wide) for px in range(0, 2000, 7) for py in range(0, 300, 7))
    assert len([r for r in got if r["frame"] == 1]) == len(wide) and max(x for x, _ in wide) == 2000 - 256
    assert [(r["x"], r["y"]) for r in got if r["frame"] == 2] == [(0, 0)]
