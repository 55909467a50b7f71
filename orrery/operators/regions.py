"""Connected regions of masks by union-find over runs of pixels: holes, growth within a mask, and small parts.

A canvas comes as its sorted pixels and is turned into runs (row, first, last), of which there are far fewer; runs of
neighbouring rows that touch are joined. One canvas is held at a time, whatever its size; many canvases share a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from orrery.functions.clips import walk
from orrery.plans.registry import query
from orrery.sources import views

#: Side of the canvases of ``views.px``, and pixels that a region needs.
SIDE, LEAST_AREA = 24, 6


def runs_of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(row, first, last) of pixels sorted by (y, x), each once."""
    if not len(y):
        return np.empty((0, 3), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]))
    ends = np.append(starts[1:], len(y)) - 1
    return np.stack([y[starts], x[starts], x[ends]], axis=1)


def gaps_of(runs: np.ndarray, height: int, width: int) -> np.ndarray:
    """The runs of the background of a canvas."""
    out: list[tuple[int, int, int]] = []
    k = 0
    for row in range(height):
        at = 0
        while k < len(runs) and runs[k, 0] == row:
            if runs[k, 1] > at:
                out.append((row, at, runs[k, 1] - 1))
            at, k = runs[k, 2] + 1, k + 1
        if at < width:
            out.append((row, at, width - 1))
    return np.array(out, np.int64).reshape(-1, 3)


def regions(runs: np.ndarray, corners: bool = False) -> np.ndarray:
    """A number for each run: the first run of its region. ``corners``: pixels that touch at a corner are joined too."""
    root = list(range(len(runs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach, above = int(corners), 0
    for k in range(len(runs)):
        row, first, last = runs[k]
        while above < k and (runs[above, 0] < row - 1 or runs[above, 0] == row - 1 and runs[above, 2] < first - reach):
            above += 1
        j = above
        while j < k and runs[j, 0] == row - 1 and runs[j, 1] <= last + reach:
            if runs[j, 2] >= first - reach:
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
            j += 1
    return np.array([find(i) for i in range(len(runs))], np.int64)


def areas(runs: np.ndarray, region: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for (_, first, last), r in zip(runs.tolist(), region.tolist(), strict=True):
        out[r] = out.get(r, 0) + last - first + 1
    return out


def holes(runs: np.ndarray, height: int, width: int) -> np.ndarray:
    """Background runs whose region does not touch the canvas's edge (pixels joined by their sides)."""
    gaps = gaps_of(runs, height, width)
    region = regions(gaps)
    edge = (gaps[:, 0] == 0) | (gaps[:, 0] == height - 1) | (gaps[:, 1] == 0) | (gaps[:, 2] == width - 1)
    return gaps[~np.isin(region, region[edge])]


def grown(marker: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Runs of the mask's regions that hold a pixel of the marker: its growth within the mask until nothing changes."""
    region, met = regions(mask), set()
    for row, first, last in marker.tolist():
        inside = (mask[:, 0] == row) & (mask[:, 1] <= last) & (mask[:, 2] >= first)
        met |= set(region[inside].tolist())
    return mask[np.isin(region, list(met))]


def pixels(runs: np.ndarray) -> int:
    return int((runs[:, 2] - runs[:, 1] + 1).sum()) if len(runs) else 0


def of_canvases(px: DataFrame, schema: str, make) -> DataFrame:
    """``make(frame, y, x, kind)`` for the sorted pixels of each frame; px: (frame, y, x, kind), each pixel of a kind once."""

    def start():
        def call(rows: list[tuple]) -> list[tuple]:
            y, x = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
            return [make(rows[0][0], y, x, np.array([r[3] for r in rows]))]

        return call

    return walk(px.select("frame", "y", "x", "kind"), "frame", ["y", "x", "kind"], [], start, schema)


_sparse = "SELECT frame, y, x FROM px WHERE kind = 'raw' AND (y * 7 + x * 3) % 5 < 3"
_beside = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS n(dy, dx)"


@query(
    f""", m AS ({_sparse}), g AS (SELECT f.frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT frame FROM m) f, generate_series(0, {SIDE - 1}) a(y), generate_series(0, {SIDE - 1}) b(x)),
b AS (SELECT g.* FROM g LEFT JOIN m USING (frame, y, x) WHERE m.frame IS NULL),
out AS (SELECT frame, y, x FROM b WHERE y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1}) UNION SELECT b.frame, b.y, b.x FROM out JOIN {_beside} ON true JOIN b ON b.frame = out.frame AND b.y = out.y + dy AND b.x = out.x + dx)
SELECT m.frame, count(*) AS pixels, any_value(coalesce(h.n, 0)) AS filled FROM m LEFT JOIN (SELECT b.frame, count(*) AS n FROM b LEFT JOIN out USING (frame, y, x) WHERE out.frame IS NULL GROUP BY b.frame) h ON h.frame = m.frame GROUP BY m.frame""",
    "px",
)
def mk05_filled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK05: pixels of each mask (a lattice through the raw one), and those of the holes that filling adds."""

    def make(frame, y, x, kind):
        own = runs_of(y, x)
        return frame, pixels(own), pixels(holes(own, SIDE, SIDE))

    raw = views.px(spark, sf_dir).filter("kind = 'raw' AND (y * 7 + x * 3) % 5 < 3")
    return of_canvases(raw, "frame int, pixels long, filled long", make)


@query(
    f""", m AS (SELECT frame, y, x FROM px WHERE kind = 'raw'), s AS (SELECT m.* FROM m JOIN px o ON o.kind = 'out' AND o.frame = m.frame AND o.y = m.y AND o.x = m.x WHERE m.y < 4),
grow AS (SELECT frame, y, x FROM s UNION SELECT m.frame, m.y, m.x FROM grow JOIN {_beside} ON true JOIN m ON m.frame = grow.frame AND m.y = grow.y + dy AND m.x = grow.x + dx)
SELECT m.frame, count(*) AS pixels, any_value(coalesce(g.n, 0)) AS grown FROM m LEFT JOIN (SELECT frame, count(*) AS n FROM grow GROUP BY frame) g ON g.frame = m.frame GROUP BY m.frame""",
    "px",
)
def mk05_geodesic_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK05: the part of each raw mask that grows from a marker (its four top rows within the other mask) without leaving the mask."""

    def make(frame, y, x, kind):
        own = kind == "raw"
        place = y * SIDE + x
        both = own & np.isin(place, place[kind == "out"]) & (y < 4)
        mask = runs_of(y[own], x[own])
        return frame, pixels(mask), pixels(grown(runs_of(y[both], x[both]), mask))

    return of_canvases(views.px(spark, sf_dir), "frame int, pixels long, grown long", make).filter("pixels > 0")


@query(
    f""", m AS (SELECT frame, y, x, y * {SIDE} + x AS id FROM px WHERE kind = 'raw' AND (y + x * 2) % 3 < 2),
reach AS (SELECT frame, id, y, x, id AS other FROM m UNION SELECT r.frame, r.id, m.y, m.x, m.id FROM reach r JOIN {_beside} ON true JOIN m ON m.frame = r.frame AND m.y = r.y + dy AND m.x = r.x + dx),
c AS (SELECT frame, id, min(other) AS region FROM reach GROUP BY ALL), a AS (SELECT frame, region, count(*) AS n FROM c GROUP BY ALL)
SELECT frame, count(*) AS regions, count(*) FILTER (n >= {LEAST_AREA}) AS kept, CAST(coalesce(sum(n) FILTER (n >= {LEAST_AREA}), 0) AS BIGINT) AS pixels, max(n) AS largest FROM a GROUP BY frame""",
    "px",
)
def mk04_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK04: regions of each mask (a lattice through the raw one), those of LEAST_AREA pixels or more, and the largest."""

    def make(frame, y, x, kind):
        own = runs_of(y, x)
        size = list(areas(own, regions(own)).values())
        kept = [n for n in size if n >= LEAST_AREA]
        return frame, len(size), len(kept), sum(kept), max(size)

    raw = views.px(spark, sf_dir).filter("kind = 'raw' AND (y + x * 2) % 3 < 2")
    return of_canvases(raw, "frame int, regions long, kept long, pixels long, largest long", make)
