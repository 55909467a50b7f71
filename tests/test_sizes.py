"""Steps whose cost must not grow faster than the input: what their plans may not hold, and results on small odd tables."""

import itertools

import pytest

from orrery.operators import carries, masks, shapes, silhouettes
from orrery.plans import catalog


def plan(spark, sf_dir, name):
    return catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["au01_uncovered", "au02_reveals", "au03_reveals_by_fill", "mk03_open_close", "flt11_joints_near_mask"])
def test_no_pixel_is_a_row_of_a_join(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "sequence(" not in text and "bit_or" in text.lower()


def test_windows_of_bitmaps(spark):
    here = [(1, 0, 0), (1, 0, 23), (1, 23, 23), (1, 5, 7), (1, 5, 7), (1, 6, 8), (1, None, 3), (1, 24, 1), (2, 3, 3)]
    bits = masks.bitmaps(spark.createDataFrame(here, "frame int, y int, x int"))
    at = spark.createDataFrame([(1, y, x) for y, x in itertools.product(range(-1, 24), repeat=2)] + [(1, None, 2)], "frame int, y int, x int")
    got = {(r.y, r.x): r.n for r in at.join(bits, "frame").selectExpr("y", "x", f"{masks.window('rows', 'y', 'x', 3, 3)} AS n").collect()}
    real = {(y, x) for f, y, x in here if f == 1 and y is not None and y < 24}
    assert got == {(y, x): 0 if y is None else sum((y + i, x + j) in real for i in range(3) for j in range(3)) for y, x in got}


def test_intervals_are_not_paired_with_samples(spark, tmp_path):
    rows = [(1, "a", 3.0), (2, "a", 0.0), (3, "a", -1.0), (4, "b", 500.0), (5, "a", 240.0), (6, None, 9.0), (7, "a", None)]
    df = spark.createDataFrame([(k, 1_700_000_000 + 60 * k * 30, kind, v) for k, kind, v in rows], "event_id long, s long, event_type string, value double")
    df.selectExpr("event_id", "timestamp_seconds(s) AS ts", "1L AS user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.iteration: (r.samples, r.mean) for r in catalog.QUERIES["jn05_interval_join"](spark, str(tmp_path)).collect()}
    at = {k: 1800 * k for k, _, _ in rows}
    for k, kind, v in rows:
        inside = [w for j, other, w in rows if kind is not None and other == kind and v is not None and at[k] - 60 * v <= at[j] <= at[k]]
        known = [w for w in inside if w is not None]
        assert got[k] == (len(inside), round(sum(known) / len(known), 6) if known else None)


def test_graph_tables_do_not_pass_the_driver(spark, sf_dir):
    assert "BroadcastHashJoin" not in plan(spark, sf_dir, "gr08_reaches_class")


def test_nearest_pose_keeps_no_structs(spark, sf_dir):
    assert "SortAggregate" not in plan(spark, sf_dir, "jn22_nearest_pose")


def test_frames_in_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    mask = spark.range(40).selectExpr("cast(id AS int) AS frame", "explode(sequence(0, 9)) AS y", "1 AS x")
    monkeypatch.setattr(masks, "FRAMES", 2)
    assert masks.tasks_for(mask) == 20
    assert "hashpartitioning(frame#" in (text := silhouettes.normalised(mask)._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in text


def test_mitigated_counts(spark):
    pixels = [(0, 5, 5), (1, 5, 7), (1, 6, 9), (3, 0, 0), (3, 0, 23), (7, 23, 4)]
    got = {r.frame: tuple(r)[1:] for r in shapes.mitigated_counts(masks.bitmaps(spark.createDataFrame(pixels, "frame int, y int, x int"))).collect()}
    for f in {f for f, _, _ in pixels}:
        cur, late = {(y, x) for g, y, x in pixels if g == f}, {(y, x) for g, y, x in pixels if f - 2 <= g <= f}
        ys, xs = [y for y, _ in cur], [x for _, x in cur]
        box = {(y, x) for y in range(max(0, min(ys) - 1), min(23, max(ys) + 1) + 1) for x in range(max(0, min(xs) - 1), min(23, max(xs) + 1) + 1)}
        assert got.pop(f) == (len(box | late | cur), len(box), len(late), len(cur), 0)
    assert got == {}


def test_outlines_by_batches(spark, sf_dir):
    rows = [(1, 1, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), (1, 2, [2.0, 2.0], [3.0, 3.0]), (1, 3, [0.0, None, 3.0], [0.0, 0.0, 4.0])]
    got = {(r.det, r.k): (r.x, r.y) for r in carries.outlines(spark.createDataFrame(rows, "frame long, det long, cx array<double>, cy array<double>"), 8).collect()}
    assert [got[1, k] for k in range(8)] == [(0, 0), (2, 0), (4, 0), (4, 2), (4, 4), (2, 4), (0, 4), (0, 2)]
    assert all(got[2, k] == (2, 3) for k in range(8)) and got[3, 7] == (None, None) and len(got) == 24
    assert "MapInArrow" in plan(spark, sf_dir, "fn47_outline")
