"""Readers on files written here, and the helpers that have no query."""

import json

import numpy as np
import pytest

from orrery.operators.graph import climb, marks_above
from orrery.operators.matching import OverlapTracker
from orrery.operators.signals import followed, smoothed
from orrery.sources import readers, sinks


def test_tracklets(spark, tmp_path):
    good = lambda k: ",".join(str(k + j / 10) for j in range(51))
    for name, lines in {"7-nm-1-90": [good(k) for k in range(70)], "7-bg-2-18": [good(0)] * 20, "8-cl-1-0": [good(1)] * 61 + ["1,2,3", good(1).replace("1.1", "x", 1)], "odd": [good(0)] * 80}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "pose.csv").write_text("\n".join(["frame,values", *lines]))
    rows = {(r.subject, r.status): r for r in readers.tracklets(spark, str(tmp_path)).collect()}
    assert set(rows) == {(7, "nm"), (8, "cl")}
    assert rows[8, "cl"].bad == 2 and rows[8, "cl"].frames == 61
    assert [p[0] for p in rows[7, "nm"].poses] == [float(k) for k in range(70)] and len(rows[7, "nm"].poses[0]) == 51
    assert [r.subject for r in readers.tracklets(spark, str(tmp_path), [8]).collect()] == [8]


def test_vectors_and_items(spark, tmp_path):
    spark.createDataFrame([("raw::1|0|2|90", [1.0]), ("bad", [2.0]), ("raw::1|2", [3.0])], "name string, v array<double>").write.parquet(f"{tmp_path}/v")
    assert [tuple(r) for r in readers.cached_vectors(spark, f"{tmp_path}/v").collect()] == [("raw", 1, 0, 2, 90, [1.0])]
    spark.createDataFrame([("a", "raw", i) for i in range(24)] + [("b", "raw", i) for i in range(23)] + [("c", "raw", i) for i in range(30)], "clip string, arm string, frame int").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(c, c.upper(), "x") for c in "abc"], "clip string, identity string, condition string").write.parquet(f"{tmp_path}/m")
    got = readers.arm_items(spark, f"{tmp_path}/s", f"{tmp_path}/m", spark.createDataFrame([("c",)], "clip string")).collect()
    assert [(r.clip, r.frames, r.identity) for r in got] == [("a", 24, "A")]


def test_logs(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"clip": "a", "epsilon": 1.5, "values": [1, null, 3]}\nnoise {"x"\n{"other": 1}\n')
    assert [(r.clip, r.i, r.value) for r in readers.calibration(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", 0, 1.0), ("a", 2, 3.0)]
    (tmp_path / "s.csv").write_text("iso,label,watts\n2026-01-01T00:00:00,gpu-1,2.5\nnever,gpu-1,1\n2026-01-01T00:00:01,cpu,1\n")
    assert [(r.label, r.watts) for r in readers.samples(spark, str(tmp_path / "s.csv"), "gpu").collect()] == [("gpu-1", 2.5)]
    lines = [{"phase": "p", "ts": "b", "ms": 1, "frames": 1}, {"phase": "p", "ts": "a", "ms": 2, "frames": 1}, {"phase": "p", "ts": "b", "ms": 3, "frames": 1}, {"phase": "q", "ts": "c", "ms": 4, "frames": 1}]
    (tmp_path / "i.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [(r.ts, r.ms) for r in readers.iterations(spark, str(tmp_path / "i.jsonl"), "p").collect()] == [("a", 2), ("b", 1)]
    text = spark.createDataFrame([("temperature: 314 level: 80 busy: 12.5 % step 3 step 14",), ("nothing",)], "t string")
    assert [tuple(r.f) for r in text.select(readers.device_facts(text["t"]).alias("f")).collect()] == [(31.4, 80.0, 12.5, [3, 14]), (None, None, None, [])]


def test_graph_manifest_layers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 1, "type": "Load"}, {"id": 2, "type": "Save", "mode": 4}], "links": [[9, 1, 0, 2, 1, "IMAGE"], [8]]}))
    nodes, edges = readers.graph(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in nodes.collect()] == [("g.json", "1", "Load", 0), ("g.json", "2", "Save", 4)]
    assert [tuple(r) for r in edges.collect()] == [("g.json", "9", "1", 0, "2", 1)]
    (tmp_path / "m.csv").write_text("filename,status,n_identities,identities,condition,source_relpath\na,KEPT,1,p010,x,s\nb,KEPT,2,p010,x,s\nc,DROPPED,1,p010,x,s\nd,KEPT,1,p001,x,s\n")
    assert [r.clip for r in readers.manifest(spark, str(tmp_path / "m.csv")).collect()] == ["a"]
    files = spark.createDataFrame([("p0.mp4",), ("p1.mp4",), ("p1_alpha.mp4",), ("plate.mp4",)], "name string")
    assert sorted(map(tuple, readers.layers(files).collect())) == [(0, "p0.mp4", None), (1, "p1.mp4", "p1_alpha.mp4")]
    todo = readers.still_to_do(spark.createDataFrame([("a",), ("b",), ("c",)], "clip string"), spark.createDataFrame([("a", True), ("b", False)], "clip string, ok boolean"))
    assert sorted(r.clip for r in todo.collect()) == ["b", "c"]


def test_report(spark, tmp_path):
    sinks.report(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ["| a | b |", "|-|-|", "| 1 |  |", "| 2 | x |"]
    with pytest.raises(ValueError):
        sinks.report(spark.range(5), f"{tmp_path}/q", most=4)


def test_climb_has_no_depth_limit_and_ends_on_circles(spark):
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(300)] + [(1000, 1001, 1), (1001, 1002, 1), (1002, 1000, 1)], "node long, to long, weight int")
    got = {r.node: (r["at"], r.total) for r in climb(chain, chain.selectExpr("node", "to AS at", "1 AS total")).collect()}
    assert all(got[i] == (300, 300 - i) for i in range(300))
    assert all(got[i][0] is None for i in (1000, 1001, 1002))


def test_marks_rise_along_long_chains_trees_and_circles(spark):
    up = {i: i + 1 for i in range(300)} | {1000: 1001, 1001: 1002, 1002: 1000} | {2000 + i: 2000 + i // 2 for i in range(2, 200)} | {5000: 5000}
    links = spark.createDataFrame([*up.items(), (None, 7)], "node long, to long")
    for marks in ([], [0], [120, 1001, 2150, 5000, 9999, 9999, None], [299, 2001]):
        want, todo = set(), [m for m in marks if m is not None]
        while todo:
            if (m := todo.pop()) not in want:
                want.add(m)
                todo += [up[m]] if m in up else []
        got = [r.node for r in marks_above(links, spark.createDataFrame([(m,) for m in marks], "node long")).collect()]
        assert set(got) == want and len(got) == len(want)


def test_trackers_and_filters():
    t = OverlapTracker()
    assert t.step([(0, 0, 10, 10), (100, 0, 110, 10)]) == [0, 1]
    assert t.step([(101, 0, 111, 10), (1, 0, 11, 10), (50, 0, 60, 10)]) == [1, 0, 2]
    assert t.step([(300, 0, 310, 10)]) == [3]
    z = [0.0, 10.0, 0.0, 10.0, 0.0]
    s = smoothed(np.array(z))
    assert s.min() > 0 and s.max() < 10 and list(smoothed(np.array([4.0, 4.0, 4.0]))) == [4.0, 4.0, 4.0]
    assert list(followed(np.array([0.0, 100.0, 100.0]))) == [0.0, 8.0, 16.0]


def test_annotations(spark, tmp_path):
    for name, text in {
        "a_frame1_output.json": '[{"bbox_xyxy": [1, 2, 3.5, 4], "label": "p"}, {"bbox_xyxy": [5, 6, 7, 8]}]', "a_frame_frame12_output.json": "[]", "b_frame3_output.json": "no list",
        "b_framex_output.json": '[{"bbox_xyxy": [1, 2, 3, 4]}]', "b_output.json": "[]", "b_frame4_output.json": '[{"other": 1}]', "b_frame5.json": '[{"bbox_xyxy": [1, 2, 3, 4]}]',
    }.items():
        (tmp_path / name).write_text(text)
    got = sorted(map(tuple, readers.annotations(spark, str(tmp_path)).collect()), key=str)
    assert got == [("a", 1, 1.0, 2.0, 3.5, 4.0), ("a", 1, 5.0, 6.0, 7.0, 8.0), ("a_frame", 12, None, None, None, None)]
