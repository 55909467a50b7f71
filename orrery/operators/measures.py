"""Figures over observations: coverage, utility, flicker, robust centres, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.exprs import clamp
from orrery.plans.registry import query
from orrery.sources import views


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(""" SELECT ident, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM series GROUP BY ident""", "series")
def ag01_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG01: number, sum, mean and extremes by kind."""
    return views.series(spark, sf_dir).groupBy("ident").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value"), "mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(""", m AS (SELECT ident, label, median(value) AS m FROM series GROUP BY ident, label)
SELECT ident, round(median(m), 6) AS fill, round(max(m) - min(m), 6) AS spread FROM m GROUP BY ident""", "series")
def ag15_detected_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15, AG22: the median of medians, and how far the medians spread."""
    m = views.series(spark, sf_dir).groupBy("ident", "label").agg(F.median("value").alias("m"))
    return m.groupBy("ident").agg(r6(F.median("m"), "fill"), r6(F.max("m") - F.min("m"), "spread"))


# Bones of the public skeleton of 17 joints, as pairs of joints.
BONES = [(5, 7), (7, 9), (6, 8), (8, 10), (11, 13), (13, 15), (12, 14), (14, 16)]
_bones = ", ".join(f"({a}, {b})" for a, b in BONES)
_lengths = f""", bone(a, b) AS (VALUES {_bones}),
len AS (SELECT p.clip, p.frame, a, b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d
        FROM bone JOIN pose p ON p.joint = a JOIN pose q ON q.clip = p.clip AND q.frame = p.frame AND q.joint = b),
per AS (SELECT clip, a, b, median(d) AS m FROM len GROUP BY clip, a, b)"""


def bone_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by clip of each bone's length: (clip, a, b, m). Joints of a frame are packed together first, so no self-join."""
    joints = views.pose(spark, sf_dir).groupBy("clip", "frame").agg(F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y")))).alias("j"))
    bones = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in BONES])).alias("o")
    ends = joints.select("clip", bones, "j").select("clip", "o.a", "o.b", F.try_element_at("j", F.col("o.a")).alias("p"), F.try_element_at("j", F.col("o.b")).alias("q"))
    d = ends.withColumn("d", F.sqrt(F.pow(F.col("p.x") - F.col("q.x"), 2) + F.pow(F.col("p.y") - F.col("q.y"), 2))).filter("d is not null")
    return d.groupBy("clip", "a", "b").agg(F.median("d").alias("m"))


@query(_lengths + " SELECT a, b, round(median(m), 6) AS template, count(*) AS clips FROM per GROUP BY a, b", "pose")
def ag22_population_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21, AG22: median bone lengths of each clip, and their median over all clips."""
    return bone_lengths(spark, sf_dir).groupBy("a", "b").agg(r6(F.median("m"), "template"), F.count("*").alias("clips"))


@query(""", f AS (SELECT kind, frame, count(*) AS n FROM px GROUP BY kind, frame)
SELECT kind, count(*) AS frames, CAST(sum(n) AS BIGINT) AS pixels, round(sum(n) / (576.0 * count(*)), 6) AS coverage, round(min(n) / 576.0, 6) AS least FROM f GROUP BY kind""", "px")
def ag24_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24: coverage from partial sums by frame."""
    f = views.px(spark, sf_dir).groupBy("kind", "frame").agg(F.count("*").alias("n"))
    return f.groupBy("kind").agg(F.count("*").alias("frames"), F.sum("n").alias("pixels"), r6(F.sum("n") / (576.0 * F.count("*")), "coverage"), r6(F.min("n") / 576.0, "least"))


@query(""", s AS (SELECT label, CAST(floor(value) AS BIGINT) AS v, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY value, ord) AS r FROM series)
SELECT label, any_value(n) AS n, CASE WHEN any_value(n) < 5 THEN max(CASE WHEN r = n // 2 + 1 THEN v END)
  ELSE CAST(sum(CASE WHEN r > n // 5 AND r <= n - n // 5 THEN v END) AS BIGINT) // (any_value(n) - 2 * (any_value(n) // 5)) END AS centre FROM s GROUP BY label""", "series")
def ag25_robust_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25: the upper median of fewer than five values, else the mean of the middle three fifths in whole numbers."""
    per = W.partitionBy("label")
    s = views.series(spark, sf_dir).select("label", F.floor("value").alias("v"), F.count("*").over(per).alias("n"), F.row_number().over(per.orderBy("value", "ord")).alias("r"))
    few = F.max(F.when(F.col("r") == F.expr("n div 2 + 1"), F.col("v")))
    middle = F.sum(F.when((F.col("r") > F.expr("n div 5")) & (F.col("r") <= F.expr("n - n div 5")), F.col("v")))
    out = s.groupBy("label").agg(F.first("n").alias("n"), few.alias("few"), middle.alias("middle"))
    return out.select("label", "n", F.expr("CASE WHEN n < 5 THEN few ELSE middle div (n - 2 * (n div 5)) END AS centre"))


@query(""", c AS (SELECT y, x, count(*) AS n FROM px WHERE kind = 'out' GROUP BY y, x)
SELECT y, x, n, CASE WHEN n >= 0.9 * frames THEN 'core' WHEN n >= 0.5 * frames THEN 'union' ELSE 'rare' END AS class FROM c, (SELECT max(frame) + 1 AS frames FROM px)""", "px")
def ag26_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26: pixels of the plate by the share of all frames that cover them."""
    px = views.px(spark, sf_dir)
    c = px.filter("kind = 'out'").groupBy("y", "x").agg(F.count("*").alias("n")).crossJoin(F.broadcast(views.frame_count(px)))  # one row
    return c.withColumn("class", F.expr("CASE WHEN n >= 0.9 * frames THEN 'core' WHEN n >= 0.5 * frames THEN 'union' ELSE 'rare' END")).drop("frames")


@query(""" SELECT label, round(avg(value), 6) AS luma, round(greatest(0.85, least(1.18, 50 / greatest(avg(value), 1e-9))), 6) AS gain,
 count(*) FILTER (value >= 95) AS high, count(*) FILTER (value <= 5) AS low FROM series GROUP BY label""", "series")
def ag27_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27: mean brightness, the gain towards 50 within its bounds, and how many samples are at either end."""
    gain = clamp(50 / F.greatest(F.avg("value"), F.lit(1e-9)), 0.85, 1.18)
    return views.series(spark, sf_dir).groupBy("label").agg(r6(F.avg("value"), "luma"), r6(gain, "gain"), F.count_if(F.col("value") >= 95).alias("high"), F.count_if(F.col("value") <= 5).alias("low"))


_moves = """, box AS (SELECT clip, frame, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS diagonal FROM pose GROUP BY clip, frame),
mv AS (SELECT p.clip, p.frame, p.joint, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM pose p JOIN pose q ON q.clip = p.clip AND q.joint = p.joint AND q.frame = p.frame + 1)"""


def moves(pose: DataFrame) -> DataFrame:
    """(clip, frame, joint, d): how far each joint is from where it is one frame on."""
    on = ["clip", "joint", "frame"]
    later = pose.select("clip", "joint", (F.col("frame") - 1).alias("frame"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return pose.join(later, on).select(*on, F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)).alias("d"))


@query(_moves + """ SELECT mv.clip, count(*) AS n, round(avg(CASE WHEN diagonal > 0 THEN d / diagonal END), 6) AS distance
FROM mv JOIN box ON box.clip = mv.clip AND box.frame = mv.frame GROUP BY mv.clip""", "pose")
def ag31_keypoint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG31: distance of joints between two poses as a share of the diagonal of the body's box."""
    pose = views.pose(spark, sf_dir)
    box = pose.groupBy("clip", "frame").agg(F.expr("sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2))").alias("diagonal"))
    rows = moves(pose).join(box, ["clip", "frame"])
    return rows.groupBy("clip").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("diagonal") > 0, F.col("d") / F.col("diagonal"))), "distance"))


@query(_moves + """, f AS (SELECT clip, frame, avg(d) AS m FROM mv WHERE frame % 3 = 0 GROUP BY clip, frame) SELECT clip, count(*) AS frames, round(avg(m), 6) AS mpjpe FROM f GROUP BY clip""", "pose")
def ag32_pose_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG32: mean joint error of every third frame, then of clips."""
    f = moves(views.pose(spark, sf_dir)).filter("frame % 3 = 0").groupBy("clip", "frame").agg(F.avg("d").alias("m"))
    return f.groupBy("clip").agg(F.count("*").alias("frames"), r6(F.avg("m"), "mpjpe"))


_arrows = ", ".join(f"({a}, {b})" for a, b in BONES)
_angle = f""", bone(a, b) AS (VALUES {_arrows}),
v AS (SELECT p.clip, p.frame, a, b, q.x - p.x AS dx, q.y - p.y AS dy FROM bone JOIN pose p ON p.joint = a JOIN pose q ON q.clip = p.clip AND q.frame = p.frame AND q.joint = b),
e AS (SELECT u.clip, degrees(acos(greatest(-1.0, least(1.0, round((u.dx * w.dx + u.dy * w.dy) / (sqrt(u.dx * u.dx + u.dy * u.dy) * sqrt(w.dx * w.dx + w.dy * w.dy)), 12))))) AS angle
      FROM v u JOIN v w ON w.clip = u.clip AND w.a = u.a AND w.b = u.b AND w.frame = u.frame + 1
      WHERE u.dx * u.dx + u.dy * u.dy > 0 AND w.dx * w.dx + w.dy * w.dy > 0)
SELECT clip, count(*) AS n, round(avg(angle), 4) AS angle FROM e GROUP BY clip"""


@query(_angle, "pose")
def fn16_bone_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16, AG32: the angle between a bone and itself one frame on, in degrees."""
    joints = views.pose(spark, sf_dir).groupBy("clip", "frame").agg(F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y")))).alias("j"))
    bones = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in BONES])).alias("o")
    v = joints.select("clip", "frame", bones, "j").select("clip", "frame", "o.a", "o.b", F.try_element_at("j", F.col("o.a")).alias("p"), F.try_element_at("j", F.col("o.b")).alias("q"))
    v = v.selectExpr("clip", "frame", "a", "b", "q.x - p.x AS dx", "q.y - p.y AS dy").filter("dx * dx + dy * dy > 0")
    w = v.selectExpr("clip", "a", "b", "frame - 1 AS frame", "dx AS ex", "dy AS ey")
    cosine = F.round((F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")) / (F.expr("sqrt(dx * dx + dy * dy)") * F.expr("sqrt(ex * ex + ey * ey)")), 12)
    e = v.join(w, ["clip", "a", "b", "frame"]).select("clip", F.degrees(F.acos(clamp(cosine, -1.0, 1.0))).alias("angle"))
    return e.groupBy("clip").agg(F.count("*").alias("n"), F.round(F.avg("angle"), 4).alias("angle"))


_part = "CASE WHEN joint < 5 THEN 'head' WHEN joint < 11 THEN 'arms' ELSE 'legs' END"


@query(_moves + f""", torso AS (SELECT p.clip, median(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS t FROM pose p JOIN pose q ON q.clip = p.clip AND q.frame = p.frame AND q.joint = 11 WHERE p.joint = 5 GROUP BY p.clip)
SELECT {_part} AS part, count(*) AS n, round(100 * avg(d / t), 6) AS share FROM mv JOIN torso ON torso.clip = mv.clip WHERE t > 0 GROUP BY 1""", "pose")
def ag33_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG33: displacement of joint groups in per cent of the clip's torso."""
    pose = views.pose(spark, sf_dir)
    p, q = pose.filter("joint = 5").alias("p"), pose.filter("joint = 11").alias("q")
    d = F.sqrt(F.pow(F.col("p.x") - F.col("q.x"), 2) + F.pow(F.col("p.y") - F.col("q.y"), 2))
    torso = p.join(q, (F.col("p.clip") == F.col("q.clip")) & (F.col("p.frame") == F.col("q.frame"))).groupBy(F.col("p.clip").alias("clip")).agg(F.median(d).alias("t")).filter("t > 0")
    return moves(pose).join(torso, "clip").groupBy(F.expr(_part).alias("part")).agg(F.count("*").alias("n"), r6(100 * F.avg(F.col("d") / F.col("t")), "share"))


@query(" SELECT ident, round(avg(CAST(value < 10 OR value > 90 AS DOUBLE)), 6) AS outside FROM series GROUP BY ident", "series")
def ag40_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG40: the share of samples out of bounds by channel."""
    return views.series(spark, sf_dir).groupBy("ident").agg(r6(F.avg(((F.col("value") < 10) | (F.col("value") > 90)).cast("double")), "outside"))


@query(""", a AS (SELECT frame, count(*) FILTER (kind = 'raw') AS raw, count(*) FILTER (kind = 'out') AS cover FROM px GROUP BY frame)
SELECT frame, raw, cover, round(CAST(raw AS DOUBLE) / greatest(cover, 1), 6) AS per_area, cover <= 300 AS in_budget, rank() OVER (ORDER BY CAST(raw AS DOUBLE) / greatest(cover, 1) DESC) AS place FROM a""", "px")
def ag42_per_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG42: frames by what is hidden for the area spent (forty frames, so the ranking is one small partition)."""
    a = views.px(spark, sf_dir).groupBy("frame").agg(F.count_if(F.col("kind") == "raw").alias("raw"), F.count_if(F.col("kind") == "out").alias("cover"))
    ratio = F.col("raw") / F.greatest("cover", F.lit(1))
    return a.select("frame", "raw", "cover", r6(ratio, "per_area"), (F.col("cover") <= 300).alias("in_budget"), F.rank().over(W.partitionBy().orderBy(F.desc(ratio))).cast("long").alias("place"))


@query(" SELECT ident, round(sum(value) / 1000, 6) AS epsilon, count(*) AS releases FROM series GROUP BY ROLLUP (ident)", "series")
def ag44_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG44: privacy budgets add up over releases, by channel and in all."""
    return views.series(spark, sf_dir).rollup("ident").agg(r6(F.sum("value") / 1000, "epsilon"), F.count("*").alias("releases"))


@query(""", m AS (SELECT ident, label % 3 AS seed, avg(value) AS m FROM series GROUP BY ident, label % 3)
SELECT ident, count(*) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM m GROUP BY ident""", "series")
def ag46_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG46, AG34: mean and deviation over seeds, by arm."""
    m = views.series(spark, sf_dir).groupBy("ident", (F.col("label") % 3).alias("seed")).agg(F.avg("value").alias("m"))
    return m.groupBy("ident").agg(F.count("*").alias("seeds"), r6(F.avg("m"), "mean"), r6(F.stddev_samp("m"), "sd"))


@query(""", n AS (SELECT kind, frame, count(*) AS n FROM px GROUP BY kind, frame),
i AS (SELECT p.kind, p.frame, count(*) AS i FROM px p JOIN px q ON q.kind = p.kind AND q.frame = p.frame - 1 AND q.y = p.y AND q.x = p.x GROUP BY p.kind, p.frame),
u AS (SELECT a.kind, a.frame, coalesce(i, 0) AS i, a.n + b.n - coalesce(i, 0) AS u FROM n a JOIN n b ON b.kind = a.kind AND b.frame = a.frame - 1 LEFT JOIN i ON i.kind = a.kind AND i.frame = a.frame)
SELECT kind, count(*) AS steps, round(avg(1 - CAST(i AS DOUBLE) / u), 6) AS flicker, round(min(CAST(i AS DOUBLE) / u), 6) AS worst FROM u GROUP BY kind""", "px")
def wn06_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN06, AG47: one less the intersection over union of a mask with that of the frame before."""
    px = views.px(spark, sf_dir)
    n = px.groupBy("kind", "frame").agg(F.count("*").alias("n"))
    before = px.withColumn("frame", F.col("frame") + 1)
    i = px.join(before, ["kind", "frame", "y", "x"]).groupBy("kind", "frame").agg(F.count("*").alias("i"))
    both = n.join(n.select("kind", (F.col("frame") + 1).alias("frame"), F.col("n").alias("m")), ["kind", "frame"]).join(i, ["kind", "frame"], "left").fillna(0, ["i"])
    iou = F.col("i") / (F.col("n") + F.col("m") - F.col("i"))
    return both.groupBy("kind").agg(F.count("*").alias("steps"), r6(F.avg(1 - iou), "flicker"), r6(F.min(iou), "worst"))


@query(""" SELECT frame, round(count(*) / 576.0, 6) AS coverage, CASE WHEN count(*) > 100 THEN round(avg(x), 6) END AS centre, round(quantile_cont(CAST(x AS DOUBLE), 0.05), 6) AS p5,
 round((max(x) - min(x) + 1.0) / (max(y) - min(y) + 1.0), 6) AS extent FROM px WHERE kind = 'out' GROUP BY frame""", "px")
def ag49_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG49: coverage, centre (null for few pixels), fifth percentile and the ratio of extents, by frame."""
    centre = F.when(F.count("*") > 100, F.round(F.avg("x"), 6))
    extent = F.expr("(max(x) - min(x) + 1.0D) / (max(y) - min(y) + 1.0D)")
    rows = views.px(spark, sf_dir).filter("kind = 'out'").groupBy("frame")
    return rows.agg(r6(F.count("*") / 576.0, "coverage"), centre.alias("centre"), r6(F.expr("percentile(x, 0.05)"), "p5"), r6(extent, "extent"))


@query(""", f AS (SELECT kind, frame, count(*) AS n, max(score) AS best FROM box WHERE score >= 0.95 GROUP BY kind, frame)
SELECT kind, count(*) AS frames, CAST(sum(n) AS BIGINT) AS found, max(best) AS best, count(*) FILTER (n > 1) AS several FROM f GROUP BY kind""", "box")
def ag50_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG50: frames with detections, their number and the best score, by stream."""
    f = views.box(spark, sf_dir).filter("score >= 0.95").groupBy("kind", "frame").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return f.groupBy("kind").agg(F.count("*").alias("frames"), F.sum("n").alias("found"), F.max("best").alias("best"), F.count_if(F.col("n") > 1).alias("several"))


_blend = """, s AS (SELECT ord, label, value, row_number() OVER (PARTITION BY label ORDER BY us, ord) - 1 AS i FROM series),
k AS (SELECT s.*, i // 4 - w AS p FROM s, generate_series(0, 1) t(w) WHERE i // 4 - w >= 0),
m AS (SELECT label, p, avg(value) AS m FROM k GROUP BY label, p),
g AS (SELECT k.ord, m.m, 1 - abs((k.i - 4 * k.p + 0.5) / 4 - 1) AS t FROM k JOIN m ON m.label = k.label AND m.p = k.p)
SELECT ord, round(sum(m * t * t * (3 - 2 * t)) / sum(t * t * (3 - 2 * t)), 6) AS blended FROM g GROUP BY ord"""


@query(_blend, "series")
def wn14_blended_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN14, FN34: means of windows of eight that overlap by four, blended by smooth steps."""
    s = views.series(spark, sf_dir).select("ord", "label", "value", (F.row_number().over(W.partitionBy("label").orderBy("us", "ord")) - 1).alias("i"))
    k = s.withColumn("p", F.explode(F.expr("filter(array(i div 4, i div 4 - 1), p -> p >= 0)")))
    m = k.groupBy("label", "p").agg(F.avg("value").alias("m"))
    g = k.join(m, ["label", "p"]).select("ord", "m", F.expr("1 - abs((i - 4 * p + 0.5D) / 4 - 1) AS t")).withColumn("w", F.expr("t * t * (3 - 2 * t)"))
    return g.groupBy("ord").agg(r6(F.sum(F.col("m") * F.col("w")) / F.sum("w"), "blended"))
