"""Transforms of whole pose sequences: skeletons rebuilt, scaled, shifted in time and held near what they were.

A frame's joints (19 at most, the two virtual ones included) are gathered into one map, so that everything within a frame is an
expression; what looks along a sequence is a window over (clip, joint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.exprs import uniform
from orrery.plans.registry import query
from orrery.sources import views

#: Child, parent, group of the kinematic tree; 17 is the middle of the hips, where it begins, 18 the middle of the shoulders.
TREE = [
    (18, 17, "torso"), (5, 18, "torso"), (6, 18, "torso"), (11, 17, "torso"), (12, 17, "torso"),
    (0, 18, "head"), (1, 0, "head"), (2, 0, "head"), (3, 1, "head"), (4, 2, "head"),
    (7, 5, "arm"), (8, 6, "arm"), (9, 7, "arm"), (10, 8, "arm"),
    (13, 11, "leg"), (14, 12, "leg"), (15, 13, "leg"), (16, 14, "leg"),
]
SCALES = {"torso": 1.05, "head": 0.9, "arm": 1.1, "leg": 0.95}
_parent = {c: (p, g) for c, p, g in TREE}


def path(joint: int) -> list[tuple[int, int, str]]:
    """The bones from the root to a joint."""
    if joint == 17:
        return []
    p, g = _parent[joint]
    return [*path(p), (joint, p, g)]


_bones = "bone AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {p}, '{g}', {SCALES[g]}e0)" for c, p, g in TREE) + ") AS t(child, parent, grp, scale))"
_paths = "path AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {c})" for j in range(17) for c, _, _ in path(j)) + ") AS t(joint, child))"
_body = (
    ", body AS (SELECT * FROM pose UNION ALL SELECT clip, frame, CASE WHEN joint > 10 THEN 17 ELSE 18 END, avg(x), avg(y) FROM pose WHERE joint IN (5, 6, 11, 12)"
    f" GROUP BY ALL HAVING count(*) = 2), {_bones}, {_paths},"
    " vec AS (SELECT c.clip, c.frame, child, grp, scale, c.x - p.x AS dx, c.y - p.y AS dy FROM bone JOIN body c ON c.joint = child JOIN body p ON p.clip = c.clip AND p.frame = c.frame AND p.joint = parent)"
)


def bodies(pose: DataFrame) -> DataFrame:
    """(clip, frame, m): the joints of a frame by number, with both virtual ones (null where one of their two joints lacks)."""
    m = F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y"))))
    middle = lambda a, b: f"named_struct('x', (m[{a}].x + m[{b}].x) / 2, 'y', (m[{a}].y + m[{b}].y) / 2)"
    return pose.groupBy("clip", "frame").agg(m.alias("m")).withColumn("m", F.expr(f"map_concat(m, map(17, {middle(11, 12)}, 18, {middle(5, 6)}))"))


def rebuilt(axis: str, joint: int) -> str:
    bones = " + ".join(f"{SCALES[g]}D * (m[{c}].{axis} - m[{p}].{axis})" for c, p, g in path(joint))
    return f"m[17].{axis} + ({bones})"


@query(
    _body + ", s AS (SELECT clip, frame, path.joint, sum(scale * dx) AS dx, sum(scale * dy) AS dy, count(*) AS n FROM path JOIN vec USING (child) GROUP BY ALL), need AS (SELECT joint, count(*) AS n FROM path GROUP BY joint)"
    " SELECT s.clip, s.frame, s.joint, round(r.x + dx, 9) AS x, round(r.y + dy, 9) AS y FROM s JOIN need ON need.joint = s.joint AND need.n = s.n JOIN body r ON r.clip = s.clip AND r.frame = s.frame AND r.joint = 17",
    "pose",
)
def po02_rebuilt_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO02: forward kinematics, every bone scaled by its group; a joint with a missing bone on its way is left out."""
    joints = ", ".join(f"named_struct('joint', {j}, 'x', {rebuilt('x', j)}, 'y', {rebuilt('y', j)})" for j in range(17))
    out = bodies(views.pose(spark, sf_dir)).selectExpr("clip", "frame", f"inline(array({joints}))").filter("x is not null")
    return out.select("clip", "frame", "joint", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(_body + " SELECT clip, child, grp, count(*) AS n, round(avg(sqrt(dx * dx + dy * dy)), 4) AS length, round(avg(sqrt(dx * dx + dy * dy)) * min(scale), 4) AS length_after FROM vec GROUP BY clip, child, grp", "pose")
def po16_bone_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO16: mean length of each bone over a clip, before and after scaling."""
    length = lambda c, p: f"sqrt(pow(m[{c}].x - m[{p}].x, 2) + pow(m[{c}].y - m[{p}].y, 2))"
    bones = ", ".join(f"named_struct('child', {c}, 'grp', '{g}', 'scale', {SCALES[g]}D, 'l', {length(c, p)})" for c, p, g in TREE)
    rows = bodies(views.pose(spark, sf_dir)).selectExpr("clip", f"inline(array({bones}))").filter("l is not null")
    return rows.groupBy("clip", "child", "grp").agg(F.count("*").alias("n"), F.round(F.avg("l"), 4).alias("length"), F.round(F.avg("l") * F.min("scale"), 4).alias("length_after"))


@query(
    _body + " SELECT v.clip, v.frame, child, round(dx, 4) AS bone_x, round(dy, 4) AS bone_y, round(n.x - c.x, 4) AS speed_x, round(n.y - c.y, 4) AS speed_y FROM vec v JOIN body c ON c.clip = v.clip AND c.frame = v.frame AND c.joint = child"
    " LEFT JOIN body n ON n.clip = v.clip AND n.frame = v.frame + 1 AND n.joint = child WHERE child < 17",
    "pose",
)
def po17_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO17: per joint the bone that leads to it and its step to the next frame (null where that lacks)."""
    bones = ", ".join(f"named_struct('child', {c}, 'x', m[{c}].x, 'y', m[{c}].y, 'dx', m[{c}].x - m[{p}].x, 'dy', m[{c}].y - m[{p}].y)" for c, p, _ in TREE if c < 17)
    rows = bodies(views.pose(spark, sf_dir)).selectExpr("clip", "frame", f"inline(array({bones}))").filter("x is not null")
    w = W.partitionBy("clip", "child").orderBy("frame")
    step = lambda k: F.when(F.lead("frame").over(w) == F.col("frame") + 1, F.round(F.lead(k).over(w) - F.col(k), 4))
    out = rows.select("clip", "frame", "child", F.round("dx", 4).alias("bone_x"), F.round("dy", 4).alias("bone_y"), step("x").alias("speed_x"), step("y").alias("speed_y"))
    return out.filter("bone_x is not null")


@query(
    _body + ", w AS (SELECT clip, median(CASE WHEN child = 5 THEN 2 * sqrt(dx * dx + dy * dy) END) AS shoulder, count(*) FILTER (child = 5) AS ns, median(CASE WHEN child = 18 THEN sqrt(dx * dx + dy * dy) END) AS spine, count(*) FILTER (child = 18) AS np FROM vec GROUP BY clip),"
    " e AS (SELECT clip, median(h) AS extent FROM (SELECT clip, frame, max(y) - min(y) AS h FROM pose GROUP BY clip, frame) GROUP BY clip)"
    " SELECT e.clip, CASE WHEN ns >= 40 THEN 'shoulder' WHEN np >= 20 THEN 'spine' ELSE 'extent' END AS kind, round(CASE WHEN ns >= 40 THEN shoulder WHEN np >= 20 THEN spine ELSE extent END, 4) AS size FROM e LEFT JOIN w ON w.clip = e.clip",
    "pose",
)
def po03_template_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO03: size of a person from the first measure seen often enough: shoulders, spine, then the extent in the image."""
    b = bodies(views.pose(spark, sf_dir))
    between = lambda c, p: F.expr(f"sqrt(pow(m[{c}].x - m[{p}].x, 2) + pow(m[{c}].y - m[{p}].y, 2))")
    ys = F.expr("transform(filter(map_entries(m), e -> e.key < 17), e -> e.value.y)")
    rows = b.select("clip", (2 * between(5, 18)).alias("shoulder"), between(18, 17).alias("spine"), (F.array_max(ys) - F.array_min(ys)).alias("extent"))
    g = rows.groupBy("clip").agg(*[F.median(k).alias(k) for k in ("shoulder", "spine", "extent")], F.count("shoulder").alias("ns"), F.count("spine").alias("np"))
    pick = lambda a, b, c: F.when(F.col("ns") >= 40, a).when(F.col("np") >= 20, b).otherwise(c)
    return g.select("clip", pick(F.lit("shoulder"), F.lit("spine"), F.lit("extent")).alias("kind"), F.round(pick(F.col("shoulder"), F.col("spine"), F.col("extent")), 4).alias("size"))


@query(
    ", t AS (SELECT clip, joint, avg(y) AS ty FROM pose GROUP BY clip, joint), c AS (SELECT clip, frame, avg(y) AS cy FROM pose GROUP BY clip, frame), m AS (SELECT clip, avg(ty) AS mt FROM t GROUP BY clip)"
    " SELECT p.clip, p.frame, count(*) AS n, round(sum((y - cy) * (ty - mt)) / sum((ty - mt) * (ty - mt)), 4) AS scale FROM pose p JOIN t ON t.clip = p.clip AND t.joint = p.joint JOIN c ON c.clip = p.clip AND c.frame = p.frame JOIN m ON m.clip = p.clip GROUP BY p.clip, p.frame",
    "pose",
)
def po04_stature_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO04: least-squares vertical scale of every frame against the clip's mean pose."""
    p = views.pose(spark, sf_dir)
    t = p.groupBy("clip", "joint").agg(F.avg("y").alias("ty")).withColumn("u", F.col("ty") - F.avg("ty").over(W.partitionBy("clip"))).select("clip", "joint", "u")
    rows = p.join(t, ["clip", "joint"]).groupBy("clip", "frame").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum("u").alias("su"), F.sum(F.col("y") * F.col("u")).alias("yu"), F.sum(F.col("u") * F.col("u")).alias("uu"))
    return rows.select("clip", "frame", "n", F.round((F.col("yu") - F.col("sy") / F.col("n") * F.col("su")) / F.col("uu"), 4).alias("scale"))


_groups = ["torso", "head", "arm", "leg"]
_draw = "(CAST('0x' || substr(md5(concat_ws('|', CAST(clip AS VARCHAR), {})), 1, 8) AS BIGINT) / 4294967296.0)"


@query(
    ", g AS (SELECT DISTINCT clip, grp FROM pose, (VALUES ('torso'), ('head'), ('arm'), ('leg')) AS t(grp)) SELECT clip, grp, round(0.85 + 0.3 * " + _draw.format("grp") + ", 6) AS scale,"
    " round(0.85 + 0.3 * " + _draw.format("grp") + " + CASE WHEN grp IN ('arm', 'leg') THEN 0.04 * (" + _draw.format("grp, 'side'") + " - 0.5) ELSE 0 END, 6) AS scale_right FROM g",
    "pose",
)
def po05_seeded_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO05: bounded scales by clip and group that follow from the key; limbs differ a little between the sides."""
    g = views.pose(spark, sf_dir).select("clip").distinct().select("clip", F.explode(F.array(*[F.lit(x) for x in _groups])).alias("grp"))
    scale = 0.85 + 0.3 * uniform(F.col("clip"), F.col("grp"))
    side = F.when(F.col("grp").isin("arm", "leg"), 0.04 * (uniform(F.col("clip"), F.col("grp"), F.lit("side")) - 0.5)).otherwise(0.0)
    return g.select("clip", "grp", F.round(scale, 6).alias("scale"), F.round(scale + side, 6).alias("scale_right"))


@query(
    ", s AS (SELECT *, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3, last_value(x) OVER (PARTITION BY clip, joint ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xl FROM pose WHERE joint BETWEEN 7 AND 10 OR joint > 12 WINDOW w AS (PARTITION BY clip, joint ORDER BY frame))"
    " SELECT clip, frame, joint, round(0.75 * coalesce(x2, xl) + 0.25 * coalesce(x3, xl), 4) AS x FROM s",
    "pose",
)
def po07_limb_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO07: limbs run 2.25 samples ahead (linear between samples, the last one held)."""
    p = views.pose(spark, sf_dir).filter("joint between 7 and 10 or joint > 12")
    w = W.partitionBy("clip", "joint").orderBy("frame")
    last = F.last("x").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ahead = lambda k: F.coalesce(F.lead("x", k).over(w), last)
    return p.select("clip", "frame", "joint", F.round(0.75 * ahead(2) + 0.25 * ahead(3), 4).alias("x"))


_swing = ", a AS (SELECT *, avg(x) OVER (PARTITION BY clip, joint) AS mx, avg(y) OVER (PARTITION BY clip, joint) AS my FROM pose), s AS (SELECT *, CASE WHEN joint BETWEEN 7 AND 10 OR joint > 12 THEN 1.3e0 ELSE 1e0 END AS k FROM a)"


def swung(pose: DataFrame) -> DataFrame:
    """nx, ny: limbs that swing 1.3 times as far about their mean place in the clip."""
    mean = pose.groupBy("clip", "joint").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    k = F.when(F.expr("joint between 7 and 10 or joint > 12"), 1.3).otherwise(1.0)
    scaled = lambda v: F.col(f"m{v}") + k * (F.col(v) - F.col(f"m{v}"))
    return pose.join(mean, ["clip", "joint"]).select("clip", "frame", "joint", "x", "y", scaled("x").alias("nx"), scaled("y").alias("ny"))


@query(_swing + " SELECT clip, frame, joint, round(mx + k * (x - mx), 4) AS x, round(my + k * (y - my), 4) AS y FROM s", "pose")
def po08_limb_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO08: the swing of limbs scaled about the clip's mean pose. Means are aggregated first, so long clips stay split."""
    return swung(views.pose(spark, sf_dir)).select("clip", "frame", "joint", F.round("nx", 4).alias("x"), F.round("ny", 4).alias("y"))


@query(
    _swing + ", d AS (SELECT clip, frame, joint, x, y, mx + k * (x - mx) - x AS dx, my + k * (y - my) - y AS dy FROM s), n AS (SELECT *, round(sqrt(dx * dx + dy * dy), 9) AS far FROM d)"
    " SELECT clip, frame, joint, far > 30 AS held, round(x + CASE WHEN far > 30 THEN dx * 30 / far ELSE dx END, 4) AS x, round(y + CASE WHEN far > 30 THEN dy * 30 / far ELSE dy END, 4) AS y FROM n",
    "pose",
)
def po11_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO11: no joint moves further than 30 pixels from where it was; the direction stays."""
    d = swung(views.pose(spark, sf_dir)).withColumns({"dx": F.col("nx") - F.col("x"), "dy": F.col("ny") - F.col("y")})
    d = d.withColumn("far", F.round(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), 9))

    def capped(v: str) -> Column:
        return F.round(F.col(v) + F.when(F.col("far") > 30, F.col(f"d{v}") * 30 / F.col("far")).otherwise(F.col(f"d{v}")), 4).alias(v)

    return d.select("clip", "frame", "joint", (F.col("far") > 30).alias("held"), capped("x"), capped("y"))


@query(
    _body + " SELECT p.clip, p.frame, p.joint, round(r.x + (p.x - r.x) * cos(0.1) - (p.y - r.y) * sin(0.1), 4) AS x, round(r.y + (p.x - r.x) * sin(0.1) + (p.y - r.y) * cos(0.1), 4) AS y"
    " FROM pose p JOIN body r ON r.clip = p.clip AND r.frame = p.frame AND r.joint = 17 WHERE p.joint < 11",
    "pose",
)
def po10_torso_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO10: everything above the hips turned by a tenth of a radian about their middle."""
    b = bodies(views.pose(spark, sf_dir)).filter("m[17].x is not null").selectExpr("clip", "frame", "m[17] AS r", "explode(map_filter(m, (k, v) -> k < 11)) AS (joint, p)")
    dx, dy, c, s = F.col("p.x") - F.col("r.x"), F.col("p.y") - F.col("r.y"), F.cos(F.lit(0.1)), F.sin(F.lit(0.1))
    return b.select("clip", "frame", "joint", F.round(F.col("r.x") + dx * c - dy * s, 4).alias("x"), F.round(F.col("r.y") + dx * s + dy * c, 4).alias("y"))
