"""Outlines put around masks that may only add: the convex hull, a hull drawn in to an area budget, and a smoothed radius.

Spark reduces a mask to the ends of its rows, or to its furthest pixel in each direction; a task holds those of one canvas at a
time. What is kept, counted and filled is a column expression. The mask itself is always part of the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.clips import walk
from orrery.operators.masks import PIXEL, of_kind, tasks_for
from orrery.plans.registry import query
from orrery.sources import views

#: Side of the canvases of ``views.px``; area allowed for a figure, as a part of its mask's; directions and harmonics of a radius.
SIDE, BUDGET, BINS, HARMONICS = 24, 1.3, 24, 3


def envelope(points: list[tuple[int, int]], sign: int) -> list[tuple[int, int]]:
    """The corners (row, x) of the hull on one side (1: left, -1: right) of points in the order of rows."""
    out: list[tuple[int, int]] = []
    for y, x in points:
        while len(out) > 1 and sign * ((out[-1][1] - out[-2][1]) * (y - out[-2][0]) - (x - out[-2][1]) * (out[-1][0] - out[-2][0])) >= 0:
            out.pop()
        out.append((y, x))
    return out


def spans(rows: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(row, first, last) of the pixels in the hull of rows (row, first, last), sorted; and its sides, (n, 2, 2) as (row, x), in order around."""
    left, right = envelope([(y, a) for y, a, _ in rows], 1), envelope([(y, b) for y, _, b in rows], -1)
    bounds = []
    for chain, up in ((left, -1), (right, 1)):
        at = {}
        for (y0, x0), (y1, x1) in zip(chain, chain[1:]):
            for y in range(y0, y1 + 1):
                at[y] = up * ((up * (x0 * (y1 - y0) + (x1 - x0) * (y - y0))) // (y1 - y0))
        bounds.append(at or {chain[0][0]: chain[0][1]})
    corners = left + right[::-1]
    sides = np.array([(a, b) for a, b in zip(corners, corners[1:] + corners[:1]) if a != b], float).reshape(-1, 2, 2)
    return [(y, bounds[0][y], bounds[1][y]) for y in range(rows[0][0], rows[-1][0] + 1)], sides


def gauge(sides: np.ndarray, middle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far the hull must reach about its middle (0 there, 1 on its sides) to hold each place; 0 where it has no breadth."""
    a, d = sides[:, 0], sides[:, 1] - sides[:, 0]
    beside = lambda p: d[:, 0] * (p[:, None, 1] - a[:, 1]) - d[:, 1] * (p[:, None, 0] - a[:, 0])
    own = beside(middle[None])[0]
    use = np.abs(own) > 1e-9
    return 1 - (beside(at)[:, use] / own[use]).min(axis=1) if use.any() else np.zeros(len(at))


def hull_of() -> Callable[[list[tuple]], list[tuple]]:
    """Called with the rows (frame, y, a, b) of a canvas; gives (frame, y, x, g)."""

    def step(rows: list[tuple]) -> list[tuple]:
        ends = [(int(y), int(a), int(b)) for _, y, a, b in rows]
        filled, sides = spans(ends)
        at = np.array([(y, x) for y, a, b in filled for x in range(a, b + 1)], float)
        middle = np.array([(y, x) for y, a, b in ends for x in (a, b)], float).mean(axis=0)
        return [(rows[0][0], int(y), int(x), round(float(g), 6) + 0.0) for (y, x), g in zip(at, gauge(sides, middle, at), strict=True)]

    return step


def hulls(mask: DataFrame) -> DataFrame:
    """(frame, y, x, g) of every pixel in the convex hull of a frame's pixels (frame, y, x); g: see ``gauge``.

    Repeated pixels count once, null places are left out, an empty mask has no hull; one pixel or line is its own.
    """
    rows = mask.filter("frame is not null and y is not null and x is not null").groupBy("frame", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return walk(rows.select("frame", "y", "a", "b"), "frame", ["y"], ["frame"], hull_of, "frame int, y int, x int, g double")


def within_budget(mask: DataFrame, budget: float = BUDGET) -> DataFrame:
    """MK08: (frame, y, x, g, mine) of a mask and of its hull drawn in about its middle as little as keeps all within ``budget`` times the mask's area.

    Pixels equally far out are added together or not at all; of a budget under 1 the mask remains.
    """
    mask = mask.distinct().withColumn("mine", F.lit(True))
    h = hulls(mask).join(mask, PIXEL, "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    per = W.partitionBy("frame")
    base, added = F.count_if("mine").over(per), F.count_if(~F.col("mine")).over(per.orderBy("g"))
    return h.withColumn("base", base).withColumn("added", added).filter(F.col("mine") | (F.col("base") + F.col("added") <= budget * F.col("base"))).select(*PIXEL, "g", "mine")


_hull = """, raw AS (SELECT frame, y, x FROM px WHERE kind = 'raw'),
r AS (SELECT frame, y, min(x) AS a, max(x) AS b FROM raw GROUP BY ALL), e AS (SELECT frame, y, a AS x FROM r UNION ALL SELECT frame, y, b FROM r), p AS (SELECT DISTINCT * FROM e),
s AS (SELECT a.frame, a.y AS y0, a.x AS x0, b.y - a.y AS dy, b.x - a.x AS dx FROM p a JOIN p b ON a.frame = b.frame AND (a.y <> b.y OR a.x <> b.x)
      JOIN p c ON c.frame = a.frame GROUP BY a.frame, a.y, a.x, b.y, b.x HAVING min((b.y - a.y) * (c.x - a.x) - (b.x - a.x) * (c.y - a.y)) >= 0),
m AS (SELECT frame, avg(y) AS my, avg(x) AS mx FROM e GROUP BY frame), o AS (SELECT s.*, dy * (mx - x0) - dx * (my - y0) AS own FROM s JOIN m USING (frame)),
box AS (SELECT frame, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM p GROUP BY frame),
g AS (SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x FROM range(24) a(i), range(24) b(i)),
c AS (SELECT box.frame, g.y, g.x FROM box JOIN g ON y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2),
h AS (SELECT c.frame, c.y, c.x, round(coalesce(1 - min(CASE WHEN own > 1e-9 THEN (dy * (c.x - x0) - dx * (c.y - y0)) / own END), 0), 6) + 0.0 AS g FROM c LEFT JOIN o ON o.frame = c.frame
      GROUP BY c.frame, c.y, c.x HAVING coalesce(min(dy * (c.x - x0) - dx * (c.y - y0)), 0) >= 0)"""


@query(_hull + " SELECT frame, y, x, g FROM h", "px")
def mk07_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK07 (hull): the pixels in each mask's convex hull, with how far out they lie."""
    return hulls(of_kind(views.px(spark, sf_dir), "raw"))


@query(
    _hull + f", j AS (SELECT h.*, raw.x IS NOT NULL AS mine FROM h LEFT JOIN raw USING (frame, y, x)),"
    f" n AS (SELECT *, count(*) FILTER (mine) OVER (PARTITION BY frame) AS base, count(*) FILTER (NOT mine) OVER (PARTITION BY frame ORDER BY g) AS added FROM j)"
    f" SELECT frame, y, x, g, mine FROM n WHERE mine OR base + added <= {BUDGET}e0 * base",
    "px",
)
def mk08_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK08: masks with their hulls drawn in to the area budget. The area grows with the gauge, so a running count finds the place for all masks at once."""
    return within_budget(of_kind(views.px(spark, sf_dir), "raw"))


def low_passed(radius: np.ndarray, harmonics: int = HARMONICS) -> np.ndarray:
    """A closed profile (NaN: no pixel there, read off a line between its neighbours) without its high harmonics, raised only."""
    seen = np.flatnonzero(~np.isnan(radius))
    full = np.interp(np.arange(len(radius)), seen, radius[seen], period=len(radius))
    part = np.fft.rfft(full)
    part[harmonics + 1 :] = 0
    return np.maximum(full, np.fft.irfft(part, n=len(radius)))


def profile_of() -> Callable[[list[tuple]], list[tuple]]:
    """Called with the rows (frame, bin, d) of a canvas; gives (frame, bin, radius) for every direction."""

    def step(rows: list[tuple]) -> list[tuple]:
        radius = np.full(BINS, np.nan)
        for _, k, d in rows:
            radius[int(k)] = d
        return [(rows[0][0], k, float(r)) for k, r in enumerate(low_passed(radius))]

    return step


_bin = f"cast(floor(round((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * {BINS}, 6)) AS int) % {BINS}"
_far = "round(sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)), 6)"


def radial(mask: DataFrame, side: int = SIDE) -> DataFrame:
    """MK18: (frame, y, x, mine) of a mask and all pixels of the canvas within its smoothed radius about its middle.

    The radius is raised only, so the mask is always held; a mask of one pixel stays as it is.
    """
    mask = mask.filter("frame is not null and y is not null and x is not null")
    tasks = tasks_for(mask)
    mask = mask.repartition(tasks, "frame").distinct()
    middle = mask.groupBy("frame").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    far = mask.join(middle, "frame").selectExpr("frame", f"{_bin} AS bin", f"{_far} AS d").filter("d > 0").groupBy("frame", "bin").agg(F.max("d").alias("d"))
    radius = walk(far.select("frame", "bin", "d"), "frame", ["bin"], ["frame"], profile_of, "frame int, bin int, radius double")
    reach = radius.groupBy("frame").agg(F.ceil(F.max("radius")).alias("r"), F.map_from_entries(F.collect_list(F.struct("bin", "radius"))).alias("radius")).join(middle, "frame")
    along = lambda c: f"sequence(cast(greatest(0, floor({c}) - r) AS int), cast(least({side - 1}, ceil({c}) + r) AS int))"
    spots = reach.selectExpr("*", f"explode({along('cy')}) AS y").selectExpr("*", f"explode({along('cx')}) AS x")
    inside = spots.filter(f"{_far} <= round(radius[{_bin}], 6)").select(*PIXEL, F.lit(False).alias("mine"))
    return inside.unionByName(mask.select(*PIXEL, F.lit(True).alias("mine"))).repartition(tasks, "frame").groupBy(*PIXEL).agg(F.bool_or("mine").alias("mine"))


@query(
    f""", raw AS (SELECT frame, y, x FROM px WHERE kind = 'raw'), c AS (SELECT frame, avg(y) AS cy, avg(x) AS cx FROM raw GROUP BY frame),
d AS (SELECT frame, {_bin} AS bin, max({_far}) AS d FROM raw JOIN c USING (frame) WHERE {_far} > 0 GROUP BY ALL),
k AS (SELECT f.frame, CAST(i.i AS INTEGER) AS i, d.d FROM (SELECT DISTINCT frame FROM d) f CROSS JOIN range(-{BINS}, {2 * BINS}) i(i) LEFT JOIN d ON d.frame = f.frame AND d.bin = (i.i + {BINS}) % {BINS}),
b AS (SELECT *, last_value(CASE WHEN d IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, last_value(d IGNORE NULLS) OVER p AS d0, first_value(CASE WHEN d IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1, first_value(d IGNORE NULLS) OVER n AS d1 FROM k
      WINDOW p AS (PARTITION BY frame ORDER BY i ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY frame ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r AS (SELECT frame, i, CASE WHEN i0 = i1 THEN d0 ELSE d0 + (d1 - d0) * (i - i0) / (i1 - i0) END AS r FROM b WHERE i BETWEEN 0 AND {BINS - 1}),
s AS (SELECT a.frame, a.i AS bin, round(greatest(any_value(a.r), sum(b.r * (1 + {' + '.join(f'2 * cos(2 * pi() * {h} * (a.i - b.i) / {BINS})' for h in range(1, HARMONICS + 1))})) / {BINS}), 6) AS radius FROM r a JOIN r b ON a.frame = b.frame GROUP BY a.frame, a.i),
g AS (SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x FROM range({SIDE}) a(i), range({SIDE}) b(i)),
a AS (SELECT frame, y, x, {_bin} AS bin, {_far} AS d FROM c CROSS JOIN g),
u AS (SELECT a.frame, y, x, false AS mine FROM a JOIN s ON s.frame = a.frame AND s.bin = a.bin WHERE d <= radius UNION ALL SELECT frame, y, x, true FROM raw)
SELECT frame, y, x, bool_or(mine) AS mine FROM u GROUP BY frame, y, x""",
    "px",
)
def mk18_radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK18, MK07 (radius): masks within their low-passed radius, raised only."""
    return radial(of_kind(views.px(spark, sf_dir), "raw"))
