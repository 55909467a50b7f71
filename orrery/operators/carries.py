"""What is carried on, rebound or drawn once: stale boxes, locks, rebound graphs, outlines, projected heads, constants of a clip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.exprs import clamp, uniform
from orrery.functions.tables import keep
from orrery.operators.graph import climb, marks_above
from orrery.functions.clips import walk
from orrery.plans.registry import query
from orrery.sources import views


def carried(frames: DataFrame, age: int) -> DataFrame:
    """(clip, frame, own, carried, area) of frames (clip, frame, n, area) with their boxes and those of the frame before.

    Boxes are carried for ``age`` frames, the next frame with boxes included, and never past a clip's last one.
    """
    after = F.lead("frame").over(W.partitionBy("clip").orderBy("frame"))
    late = frames.withColumn("after", after).filter("after is not null").withColumn("last", F.least(F.col("frame") + age, F.col("after")))
    late = late.select("clip", F.explode(F.sequence(F.col("frame") + 1, "last")).alias("frame"), F.lit(0).cast("long").alias("own"), F.col("n").alias("carried"), "area")
    own = frames.select("clip", "frame", F.col("n").alias("own"), F.lit(0).cast("long").alias("carried"), "area")
    return own.unionByName(late).groupBy("clip", "frame").agg(F.sum("own").alias("own"), F.sum("carried").alias("carried"), F.sum("area").alias("area"))


@query(
    """, g AS (SELECT frame // 4096 AS clip, frame, count(*) AS n, sum((x2 - x1) * (y2 - y1)) AS area FROM box GROUP BY ALL),
n AS (SELECT *, lead(frame) OVER (PARTITION BY clip ORDER BY frame) AS later FROM g),
u AS (SELECT clip, frame, n AS own, 0 AS carried, area FROM g
  UNION ALL SELECT clip, frame + k, 0, n, area FROM n, generate_series(1, 3) t(k) WHERE frame + k <= later)
SELECT clip, frame, CAST(sum(own) AS BIGINT) AS own, CAST(sum(carried) AS BIGINT) AS carried, sum(area) AS area FROM u GROUP BY clip, frame""",
    "box",
)
def st05_stale_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST05: boxes in use in each frame: its own and, for three frames at most, those last seen."""
    g = views.box(spark, sf_dir).groupBy(F.expr("frame div 4096").alias("clip"), "frame")
    return carried(g.agg(F.count("*").alias("n"), F.expr("sum((x2 - x1) * (y2 - y1))").alias("area")), 3)


@query(
    """, s AS (SELECT label, ident, min(us) AS begins, max(us) AS ends, row_number() OVER (PARTITION BY label ORDER BY min(us), ident) AS i FROM series GROUP BY label, ident),
g AS (SELECT label, ident, begins, ends, i, false AS refused, ends AS held FROM s WHERE i = 1
      UNION ALL SELECT s.label, s.ident, s.begins, s.ends, s.i, g.held >= s.begins, CASE WHEN g.held >= s.begins THEN g.held ELSE s.ends END FROM g JOIN s ON s.label = g.label AND s.i = g.i + 1)
SELECT label, ident, begins, ends, refused FROM g""",
    "series",
)
def st12_one_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: a writer that starts while another of the same label holds the lock is refused, and holds nothing itself.

    Writers of a label come in order; a task holds one of them and the lock's end.
    """

    def start():
        held: list[int] = []

        def call(rows: list[tuple]) -> list[tuple]:
            label, ident, begins, ends = rows[0]
            refused = bool(held) and held[0] >= begins
            if not refused:
                held[:] = [ends]
            return [(label, ident, begins, ends, refused)]

        return call

    s = views.series(spark, sf_dir).groupBy("label", "ident").agg(F.min("us").alias("begins"), F.max("us").alias("ends"))
    return walk(s, "label", ["begins", "ident"], ["ident"], start, "label long, ident string, begins long, ends long, refused boolean")


@query(
    """, up AS (SELECT parent AS node FROM edge WHERE class LIKE 'Brand#3%' UNION SELECT e.parent FROM up JOIN edge e ON e.node = up.node)
SELECT e.node, up.node IS NOT NULL AS reaches FROM edge e LEFT JOIN up ON up.node = e.node""",
    "edge",
)
def gr08_reaches_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR08: whether any node below has a class with the prefix. Marks rise along doubled links, so rounds grow with the logarithm of the depth."""
    e = views.edge(spark, sf_dir)
    met = marks_above(e.select("node", F.col("parent").alias("to")), e.filter(F.col("class").startswith("Brand#3")).select(F.col("parent").alias("node")))
    return e.select("node").join(met.withColumn("reaches", F.lit(True)).hint("merge"), "node", "left").select("node", F.coalesce("reaches", F.lit(False)).alias("reaches"))


_graph = """, b AS (SELECT e.node, e.muted, e.class = 'Brand#13' AS auto, e.node > 2 AND coalesce(p.class = 'Brand#13', false) AS rebound, e.parent
  FROM edge e LEFT JOIN edge p ON p.node = e.parent),
was AS (SELECT node FROM b WHERE node = 1 UNION SELECT b.node FROM was JOIN b ON b.parent = was.node WHERE NOT b.muted),
now AS (SELECT node FROM b WHERE node = 1
  UNION SELECT b.node FROM now JOIN b ON CASE WHEN b.rebound THEN 2 ELSE b.parent END = now.node WHERE NOT b.muted AND (NOT b.auto OR b.node = 2))"""


@query(_graph + " SELECT b.node, rebound, was.node IS NOT NULL AS was_run, now.node IS NOT NULL AS is_run FROM b LEFT JOIN was ON was.node = b.node LEFT JOIN now ON now.node = b.node", "edge")
def gr12_manual_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR12: automatic sources are muted and what they fed is bound to one chosen by hand (node 2); the nodes run before and after."""
    e = views.edge(spark, sf_dir)
    auto = F.col("class") == "Brand#13"
    fed = e.filter(auto).select(F.col("node").alias("parent"), F.lit(True).alias("fed"))
    b = keep(e.join(fed, "parent", "left").select("node", "parent", "muted", auto.alias("auto"), (F.col("fed").isNotNull() & (F.col("node") > 2)).alias("rebound")))

    def run(rows: DataFrame, to: Column, name: str) -> DataFrame:
        ways = rows.filter("node <> 1").select("node", to.alias("to"), F.lit(1).alias("weight"))
        got = climb(ways, ways.select("node", F.col("to").alias("at"), F.col("weight").alias("total"))).filter("at = 1").select("node")
        return got.unionByName(b.filter("node = 1").select("node")).withColumn(name, F.lit(True))

    was = run(b.filter("NOT muted"), F.col("parent"), "was_run")
    now = run(b.filter("NOT muted AND (NOT auto OR node = 2)"), F.when(F.col("rebound"), F.lit(2)).otherwise(F.col("parent")), "is_run")
    out = b.join(was, "node", "left").join(now, "node", "left")
    return out.select("node", "rebound", *[F.coalesce(k, F.lit(False)).alias(k) for k in ("was_run", "is_run")])


@query(
    """, raw AS (SELECT DISTINCT frame, y, x FROM px WHERE kind = 'raw'),
h AS (SELECT DISTINCT win, frame + k AS frame, y, x FROM raw, (VALUES (1), (4), (8), (16)) w(win), generate_series(0, 15) t(k) WHERE k < win AND frame + k < (SELECT max(frame) + 1 FROM px)),
p AS (SELECT win, y, x, count(*) AS n FROM h GROUP BY ALL)
SELECT win, CAST(sum(n) AS BIGINT) AS pixels, round(CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM raw), 6) AS ratio, count(*) FILTER (n = (SELECT max(frame) + 1 FROM px)) AS core FROM p GROUP BY win""",
    "px",
)
def au24_window_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU24: pixels to fill in for a running union of 1, 4, 8 and 16 masks, against the masks alone; core: pixels never revealed."""
    px = views.px(spark, sf_dir)
    frames = F.broadcast(views.frame_count(px))  # one row
    raw = px.filter("kind = 'raw'").select("frame", "y", "x").crossJoin(frames)
    h = raw.withColumn("win", F.explode(F.array(*map(F.lit, (1, 4, 8, 16)))))
    h = h.select("win", F.explode(F.expr("sequence(frame, least(frame + win - 1, frames - 1))")).alias("frame"), "y", "x").distinct()
    p = h.groupBy("win", "y", "x").agg(F.count("*").alias("n"))
    out = p.crossJoin(frames).groupBy("win").agg(F.sum("n").alias("pixels"), F.count_if(F.col("n") == F.col("frames")).alias("core"))
    alone = out.filter("win = 1").select(F.col("pixels").alias("alone"))  # a window of one is the masks alone: one row
    return out.crossJoin(F.broadcast(alone)).select("win", "pixels", F.round(F.col("pixels") / F.col("alone"), 6).alias("ratio"), "core")


@query(
    """, o AS (SELECT frame, det, x1, y1, x2 - x1 AS w, y2 - y1 AS h, CAST(k AS INTEGER) AS k, k * 2 * (x2 - x1 + y2 - y1) / 16 AS t FROM box, generate_series(0, 15) s(k))
SELECT frame, det, k, round(x1 + CASE WHEN t < w THEN t WHEN t < w + h THEN w WHEN t < 2 * w + h THEN 2 * w + h - t ELSE 0 END, 6) AS x,
round(y1 + CASE WHEN t < w THEN 0 WHEN t < w + h THEN t - w WHEN t < 2 * w + h THEN h ELSE 2 * w + 2 * h - t END, 6) AS y FROM o""",
    "box",
)
def fn47_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN47: sixteen points at even steps along each box's outline."""
    box = views.box(spark, sf_dir).select("frame", "det", F.array("x1", "x2", "x2", "x1").alias("cx"), F.array("y1", "y1", "y2", "y2").alias("cy"))
    return outlines(box, 16).select("frame", "det", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def outlines(polygons: DataFrame, n: int) -> DataFrame:
    """(frame, det, k, x, y): ``n`` points at even steps along closed polygons (frame, det, cx, cy: arrays of one length each), batch by batch; null where a corner is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cx, cy = batch.column("cx"), batch.column("cy")
            size = cx.value_lengths().to_numpy(zero_copy_only=False)
            for m in np.unique(size):  # corners: few kinds
                at = pa.array(np.flatnonzero(size == m))
                part = batch.take(at)
                x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for c in ("cx", "cy"))
                dx, dy = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
                long = np.sqrt(dx * dx + dy * dy)
                begins = np.cumsum(np.concatenate([np.zeros((len(at), 1)), long[:, :-1]], axis=1), axis=1)
                way = np.arange(n)[None] * (begins[:, -1] + long[:, -1])[:, None] / n
                on = (begins[:, None, :] <= way[:, :, None]).sum(2) - 1  # the last side that begins at or before the place
                pick = lambda v, on=on: np.take_along_axis(v, on, 1)
                along = pick(long)
                share = np.where(along > 0, (way - pick(begins)) / np.where(along > 0, along, 1.0), 0.0)
                rows = pa.array(np.repeat(np.arange(len(at)), n))
                made = [part.column("frame").take(rows), part.column("det").take(rows), pa.array(np.tile(np.arange(n, dtype=np.int32), len(at)))]
                made += [pa.array((pick(v) + share * pick(d)).ravel(), from_pandas=True) for v, d in ((x, dx), (y, dy))]
                yield pa.RecordBatch.from_arrays(made, names=["frame", "det", "k", "x", "y"])

    return polygons.mapInArrow(run, "frame long, det long, k int, x double, y double")


#: Half axes of the head, distance of the eye, all in widths between the eyes (parameters of our own).
HEAD, EYE = (1.0, 1.4, 1.2), 6.0
_turn = {
    "x": "cos(r) * cos(w) * {x} + (cos(r) * sin(w) * sin(t) - sin(r) * cos(t)) * {y} + (cos(r) * sin(w) * cos(t) + sin(r) * sin(t)) * {z}",
    "y": "sin(r) * cos(w) * {x} + (sin(r) * sin(w) * sin(t) + cos(r) * cos(t)) * {y} + (sin(r) * sin(w) * cos(t) - cos(r) * sin(t)) * {z}",
    "z": "-sin(w) * {x} + cos(w) * sin(t) * {y} + cos(w) * cos(t) * {z}",
}
_angles = ["frame", "joint", "x / 600 - 0.5 AS px", "y / 300 - 0.5 AS py", "(frame % 90 - 45) * pi() / 180 AS w", "(frame % 41 - 20) * pi() / 180 AS t", "(frame % 31 - 15) * pi() / 180 AS r"]
_lift = ["*", f"{HEAD[2]} * sqrt(greatest(1 - pow(px / {HEAD[0]}, 2) - pow(py / {HEAD[1]}, 2), 0.04)) AS pz"]
_normal = {"x": f"px / {HEAD[0] ** 2}", "y": f"py / {HEAD[1] ** 2}", "z": f"pz / {HEAD[2] ** 2}"}
_seen = ["frame", "joint", *[f"{e.format(x='px', y='py', z='pz')} AS q{k}" for k, e in _turn.items()], f"{_turn['z'].format(**{k: f'({v})' for k, v in _normal.items()})} AS facing"]
_flat = ["frame", "joint", *[f"round(q{k} * {EYE} / greatest({EYE} - qz, 0.001), 6) AS {to}" for k, to in (("x", "u"), ("y", "v"))], "round(facing, 6) AS facing"]


@query(", a AS (SELECT {} FROM kp), l AS (SELECT {} FROM a), s AS (SELECT {} FROM l) SELECT {} FROM s".format(*map(", ".join, (_angles, _lift, _seen, _flat))), "kp")
def fn46_head_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN46: points lifted to an ellipsoid, turned (roll after yaw after pitch) and projected; facing: the turned normal's depth."""
    rows = views.kp(spark, sf_dir)
    for step in (_angles, _lift, _seen, _flat):
        rows = rows.selectExpr(*step)
    return rows


_parts = ("arm", "leg", "spine", "shoulder", "hip")
_listed = ", ".join(f"('{p}')" for p in _parts)


def _u(*key: str) -> str:
    """The same numbers in SQL as uniform() gives."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8) AS BIGINT) / 4294967296.0)"


@query(
    f""", p AS (SELECT DISTINCT CAST(label AS VARCHAR) AS label, part FROM series, (VALUES {_listed}) v(part)),
d AS (SELECT label, part, sqrt(-2 * ln(1 - {_u("'a'", "label", "part")})) * cos(2 * pi() * {_u("'b'", "label", "part")}) AS z, {_u("'c'", "label")} AS c FROM p)
SELECT CAST(label AS BIGINT) AS label, part, round(greatest(0.76, least(1.24, 1 + 0.12 * z)), 6) AS factor, round((2 * c - 1) * 4 * pi() / 180, 6) AS lean FROM d""",
    "series",
)
def po19_identity_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO19: per identity a length factor for each part (normal, clamped at two deviations) and one lean, from hashes."""
    p = views.series(spark, sf_dir).select("label").distinct().withColumn("part", F.explode(F.array(*map(F.lit, _parts))))
    u = lambda k: uniform(F.lit(k), F.col("label"), F.col("part"))
    z = F.sqrt(-2 * F.log(1 - u("a"))) * F.cos(2 * F.pi() * u("b"))
    lean = (2 * uniform(F.lit("c"), F.col("label")) - 1) * 4 * F.pi() / 180
    return p.select(F.col("label").cast("long").alias("label"), "part", F.round(clamp(1 + 0.12 * z, 0.76, 1.24), 6).alias("factor"), F.round(lean, 6).alias("lean"))


@query(
    f""", p AS (SELECT DISTINCT CAST(clip AS VARCHAR) AS clip, part FROM pose, (VALUES {_listed}) v(part)),
d AS (SELECT clip, part, 1 + 0.06 * (2 * {_u("'shape'", "clip", "part")} - 1) AS f, 1 + 0.03 * (2 * {_u("'left'", "clip")} - 1) AS g FROM p)
SELECT CAST(clip AS BIGINT) AS clip, part, round(f, 6) AS factor, round(CASE WHEN part IN ('arm', 'leg') THEN f * g ELSE f END, 6) AS left_factor FROM d""",
    "pose",
)
def mk19_clip_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK19: a wobble of up to 6 % for each part, drawn by clip and never by identity; left limbs get a smaller second draw."""
    p = views.pose(spark, sf_dir).select("clip").distinct().withColumn("part", F.explode(F.array(*map(F.lit, _parts))))
    f = 1 + 0.06 * (2 * uniform(F.lit("shape"), F.col("clip"), F.col("part")) - 1)
    g = 1 + 0.03 * (2 * uniform(F.lit("left"), F.col("clip")) - 1)
    left = F.when(F.col("part").isin("arm", "leg"), f * g).otherwise(f)
    return p.select(F.col("clip").cast("long").alias("clip"), "part", F.round(f, 6).alias("factor"), F.round(left, 6).alias("left_factor"))
