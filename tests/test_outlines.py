"""Outlines around masks: laws of the hull, of the budget at ties, and of the raised radius, on canvases of several sizes."""

import numpy as np
import pytest

from orrery.operators import outlines as o

PIXELS = "frame int, y int, x int"


def filled(points):
    ends = sorted({y: (y, min(x for r, x in points if r == y), max(x for r, x in points if r == y)) for y, _ in points}.values())
    rows, sides = o.spans(ends)
    return {(y, x) for y, a, b in rows for x in range(a, b + 1)}, sides


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
def test_hull_holds_the_mask_and_is_convex(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        points = {(int(y), int(x)) for y, x in rng.integers(0, 30, (n, 2))}
        inside, sides = filled(points)
        assert points <= inside
        assert filled(inside)[0] == inside  # the hull of a hull
        # brute force: no line through two points has all others on one side and a filled place on the other
        for a in points:
            for b in points - {a}:
                side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
                if min(side) >= 0:
                    assert all((b[0] - a[0]) * (x - a[1]) - (b[1] - a[1]) * (y - a[0]) >= 0 for y, x in inside)


def test_hull_fills_what_lies_within():
    assert filled({(0, 0), (0, 4), (4, 0), (4, 4)})[0] == {(y, x) for y in range(5) for x in range(5)}
    assert filled({(0, 2), (2, 0), (2, 4), (4, 2)})[0] == {(y, x) for y in range(5) for x in range(5) if abs(y - 2) + abs(x - 2) <= 2}
    assert filled({(3, 1), (3, 6)})[0] == {(3, x) for x in range(1, 7)}


def test_budget_is_used_as_far_as_ties_allow(spark):
    ring = [(1, y, x) for y in range(9) for x in range(9) if y in (0, 8) or x in (0, 8)]
    line = [(2, 5, x) for x in (1, 9)]
    mask = spark.createDataFrame([*ring, *ring, *line, (3, 4, 4), (None, 1, 1), (4, 7, None)], PIXELS)
    hull = {(r.frame, r.y, r.x): r.g for r in o.hulls(mask).collect()}
    assert sum(k[0] == 1 for k in hull) == 81 and hull[1, 4, 4] == 0 and hull[1, 0, 3] == 1 and (3, 4, 4) in hull
    assert {k[2] for k in hull if k[0] == 2} == set(range(1, 10))
    kept = {}
    for budget in (0.5, 1.0, 1.03, 1.28, 1.29, 1.5, 9.0):
        rows = o.within_budget(mask.filter("x is not null and frame is not null"), budget).collect()
        assert {(r.frame, r.y, r.x) for r in rows if r.mine} == {*ring, *line, (3, 4, 4)}
        kept[budget] = sum(r.frame == 1 and not r.mine for r in rows)
    rings = {0: 1, 1: 9, 2: 25, 3: 49}  # squares about the middle: each is added whole
    assert all(v in {0, *rings.values()} for v in kept.values())
    for budget, v in kept.items():  # the next square would not have fitted
        assert v == max([0, *(r for r in rings.values() if 32 + r <= budget * 32)])
    assert o.hulls(mask.limit(0)).collect() == []


def test_radius_is_raised_only_and_bounded():
    rng = np.random.default_rng(5)
    for _ in range(50):
        r = rng.uniform(1, 20, o.BINS)
        r[rng.random(o.BINS) < 0.4] = np.nan
        r[3] = 9.0
        s = o.low_passed(r)
        seen = ~np.isnan(r)
        assert (s[seen] >= r[seen]).all() and np.isfinite(s).all()
        np.testing.assert_allclose(o.low_passed(np.full(o.BINS, 7.0)), 7.0)
    wave = 10 + np.cos(2 * np.pi * 2 * np.arange(o.BINS) / o.BINS)
    np.testing.assert_allclose(o.low_passed(wave), wave)  # low harmonics stay


def test_radius_holds_every_pixel(spark):
    rng = np.random.default_rng(6)
    rows = [(f, int(y), int(x)) for f in range(6) for y, x in rng.integers(0, 24, (f * 9 + 1, 2))]
    got = o.radial(spark.createDataFrame([*rows, *rows, (None, 2, 2)], PIXELS)).collect()
    assert {(r.frame, r.y, r.x) for r in got if r.mine} == set(rows) and len(got) == len({(r.frame, r.y, r.x) for r in got})
    assert sum(r.frame == 0 for r in got) == 1 and all(0 <= r.y < 24 and 0 <= r.x < 24 for r in got)
