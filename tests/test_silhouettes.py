"""Silhouettes against a plain loop over the cells of the result, at several sizes, with null and repeated pixels."""

import numpy as np

from orrery.operators.silhouettes import normalised


def plain(points, size):
    ys, xs = zip(*points, strict=True)
    y0, x0 = min(ys), min(xs)
    h, w = max(ys) - y0 + 1, max(xs) - x0 + 1
    if h < 8:
        return {}
    tw = max(1, round(w * size / h))
    crop = np.zeros((h, w))
    for y, x in points:
        crop[y - y0, x - x0] = 1
    cells = {}
    for ty in range(size):
        for tx in range(tw):
            sy, sx = min(h - 1, max(0, (ty + 0.5) * h / size - 0.5)), min(w - 1, max(0, (tx + 0.5) * w / tw - 0.5))
            a, b = int(sy), int(sx)
            c, d = min(a + 1, h - 1), min(b + 1, w - 1)
            f, g = sy - a, sx - b
            v = (1 - f) * ((1 - g) * crop[a, b] + g * crop[a, d]) + f * ((1 - g) * crop[c, b] + g * crop[c, d])
            if (k := int(np.floor(round(v, 9) * 255 + 0.5))) > 0:
                cells[ty, tx] = k
    top = [x for y, x in cells if y < size // 2]
    cx = round(float(np.mean(top))) if top else tw // 2
    return {(y, x - cx + size // 2): k for (y, x), k in cells.items() if 0 <= x - cx + size // 2 < size}


def test_against_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    masks = {f: {(int(y), int(x)) for y, x in rng.integers(0, (3, 9, 20, 40)[f % 4], (30 + f, 2))} for f in range(8)}
    masks[8] = {(y, 5) for y in range(100)}  # one column, taller than the result
    masks[9] = {(y, x) for y in range(8) for x in range(40)}  # wider than the square
    rows = [(f, y, x, "z") for f, m in masks.items() for y, x in m]
    rows += rows[:5] + [(None, 1, 1, "z"), (1, None, 1, "z")]
    for size in (16, 64):
        got = {}
        for r in normalised(spark.createDataFrame(rows, "frame int, y int, x int, value string"), size).collect():
            assert (r.y, r.x) not in got.setdefault(r.frame, {})
            got[r.frame][r.y, r.x] = r.value
        assert got == {f: p for f, m in masks.items() if (p := plain(m, size))}
    assert normalised(spark.createDataFrame([], "frame int, y int, x int")).collect() == []
