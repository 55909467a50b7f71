"""Ranks and nearest rows under pivots against comparing everything."""

import numpy as np
import pytest

from orrery.operators import blocks
from orrery.operators.neighbours import grouped, nearest, nearest_own, ranks


def make(spark, rng, n, spread):
    centres = rng.normal(0, 10, (8, 4))
    v = np.round(centres[rng.integers(0, 8, n)] + rng.normal(0, spread, (n, 4)), 1)  # many ties
    return [(i, int(i % 3), [float(x) for x in v[i]]) for i in range(n)]


@pytest.fixture(scope="module", params=[0.0, 0.3, 20.0])
def tables(request, spark):
    rng = np.random.default_rng(int(request.param * 10))
    rows = make(spark, rng, 240, request.param)
    gallery, probes = rows[:160], rows[160:]
    g = spark.createDataFrame([(i, i % 7, view, v) for i, view, v in gallery] + [(999, 0, 1, None)], "gallery long, found long, view int, gv array<double>")
    return gallery, probes, g, spark.createDataFrame(probes, "probe long, view int, pv array<double>")


def far(x, y):
    return round(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)))), 9)


def order(gallery, view, pv):
    return sorted((far(pv, v), i) for i, w, v in gallery if w != view)


def test_nearest(spark, tables):
    gallery, probes, g, p = tables
    for k in (1, 5, 300):
        got = {(r.probe, r.r): (round(r.d, 9), r.gallery) for r in nearest(p, grouped(g), k=k).collect()}
        assert got == {(i, n + 1): x for i, view, v in probes for n, x in enumerate(order(gallery, view, v)[:k])}
    got = {(r.probe, r.gallery_view): (round(r.d, 9), r.gallery) for r in nearest(p, grouped(g, pivots=5), each_view=True).collect()}
    assert got == {(i, w): min((far(v, y), j) for j, u, y in gallery if u == w) for i, view, v in probes for w in range(3) if w != view}


def test_ranks(spark, tables):
    gallery, probes, g, p = tables
    targets, want = [], {}
    for i, view, v in probes:
        for n, (d, j) in list(enumerate(order(gallery, view, v)))[:: 1 + i % 9]:
            targets.append((i, view, v, j, d))
            want[i, j] = n + 1
    df = spark.createDataFrame(targets, "probe long, view int, pv array<double>, gallery long, d double")
    assert {(r.probe, r.gallery): r["rank"] for r in ranks(df, grouped(g)).collect()} == want


def test_few_groups_are_joined_where_the_gallery_is_clustered(spark):
    rng = np.random.default_rng(1)
    rows = make(spark, rng, 400, 0.2)
    g = grouped(spark.createDataFrame([(i, 0, view, v) for i, view, v in rows], "gallery long, found long, view int, gv array<double>"), pivots=30)
    lower, upper = g.bounds([v for _, _, v in rows[:20]])
    crossed = (lower <= np.sort(upper.reshape(20, -1), axis=1)[:, :1, None]).any(2).mean()
    assert crossed < 0.5
    assert "NestedLoop" not in nearest(spark.createDataFrame([(i, w, v) for i, w, v in rows[:20]], "probe long, view int, pv array<double>"), g)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "gallery long, found long, view int, gv array<double>")
    p = spark.createDataFrame([(1, 0, [0.0, 1.0])], "probe long, view int, pv array<double>")
    assert nearest(p, grouped(none)).count() == 0
    one = grouped(spark.createDataFrame([(5, 5, 0, [0.0, 1.0])], none.schema))
    assert nearest(p, one).count() == 0 and nearest(p.withColumn("view", p.view + 1), one).count() == 1 and nearest(p.limit(0), one).count() == 0


def test_a_probe_is_sent_to_blocks_and_not_to_each_group(spark, tables, monkeypatch):
    gallery, probes, g, p = tables
    monkeypatch.setattr(blocks, "LEFT", 16)
    monkeypatch.setattr(blocks, "RIGHT", 32)
    near = nearest(p, grouped(g), k=3)
    assert "FlatMapCoGroupsInArrow" in near._jdf.queryExecution().executedPlan().toString()  # pairs are rows of no join
    got = {(r.probe, r.r): (round(r.d, 9), r.gallery) for r in near.collect()}
    assert got == {(i, n + 1): x for i, view, v in probes for n, x in enumerate(order(gallery, view, v)[:3])}
    want = {(i, order(gallery, view, v)[5 + i % 60][1]): 6 + i % 60 for i, view, v in probes}
    at = {i: v for i, _, v in gallery}
    rows = [(i, view, v, j, far(v, at[j])) for i, view, v in probes for k, j in want if k == i]
    df = spark.createDataFrame(rows, "probe long, view int, pv array<double>, gallery long, d double")
    assert {(r.probe, r.gallery): r["rank"] for r in ranks(df, grouped(g)).collect()} == want
    key = lambda i: i % 4
    own = nearest_own(p.selectExpr("probe", "probe % 4 AS key", "view", "pv"), g.selectExpr("gallery", "gallery % 4 AS key", "view", "gv"))
    assert {r.probe: (round(r.d, 9), r.gallery) for r in own.collect()} == {i: order([x for x in gallery if key(x[0]) == key(i)], view, v)[0] for i, view, v in probes}
