"""Boxes: geometry, matching and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.exprs import area, clamp, iou
from orrery.plans.registry import query
from orrery.sources import views

_inter = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_iou = f"({_inter}) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_inter})"


@query(" SELECT frame, det, greatest(0, least(640, x1)) AS x1, greatest(0, least(640, x2)) AS x2, greatest(0, least(360, y1)) AS y1, greatest(0, least(360, y2)) AS y2 FROM box WHERE greatest(0, least(640, x2)) > greatest(0, least(640, x1)) AND greatest(0, least(360, y2)) > greatest(0, least(360, y1))", "box")
def flt09_clip_to_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT09, FN10: boxes cut to the canvas; empty ones go."""
    b = views.box(spark, sf_dir)
    return b.select("frame", "det", *[clamp(F.col(c), 0.0, 640.0 if c[0] == "x" else 360.0).alias(c) for c in ("x1", "x2", "y1", "y2")]).filter("x2 > x1 AND y2 > y1")


@query(" SELECT frame, det, round((x2 - x1) * (y2 - y1), 6) AS area, round((x2 - x1) / (y2 - y1), 6) AS aspect, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS diagonal FROM box WHERE y2 - y1 >= 60", "box")
def fn20_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN20, FLT05: area, aspect, centre and diagonal of boxes of some height."""
    b = views.box(spark, sf_dir).filter("y2 - y1 >= 60").alias("b")
    return b.select("frame", "det", F.round(area("b"), 6).alias("area"), F.expr("round((x2 - x1) / (y2 - y1), 6) AS aspect"), F.expr("(x1 + x2) / 2 AS cx"), F.expr("(y1 + y2) / 2 AS cy"), F.expr("round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS diagonal"))


@query(" SELECT frame, det, CAST(frame // 3 AS BIGINT) AS e, round_even(score * 31, 0) / 31 AS level FROM box WHERE frame % 3 = 0", "box")
def flt03_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT03, JN04, FN11: every third frame under its new number; scores on 32 levels, halves to even."""
    return views.box(spark, sf_dir).filter("pmod(frame, 3) = 0").select("frame", "det", F.expr("frame div 3 AS e"), (F.bround(F.col("score") * 31, 0) / 31).alias("level"))


@query(f", a AS (SELECT * FROM box WHERE kind = 'N'), b AS (SELECT * FROM box WHERE kind <> 'N'), m AS (SELECT a.frame AS frame, a.det AS det, b.det AS found, round({_iou}, 9) AS iou FROM a JOIN b ON a.frame = b.frame), k AS (SELECT *, row_number() OVER (PARTITION BY frame, det ORDER BY iou DESC, found) AS k FROM m WHERE iou >= 0.10) SELECT a.frame AS frame, a.det AS det, found, round(iou, 6) AS iou FROM a LEFT JOIN k ON k.frame = a.frame AND k.det = a.det AND k = 1", "box")
def jn07_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN07-JN09: each annotation's best detection by intersection over union, if it reaches a tenth; else null."""
    box = views.box(spark, sf_dir)
    a, b = box.filter("kind = 'N'").alias("a"), box.filter("kind <> 'N'").alias("b")
    met = a.join(b, F.col("a.frame") == F.col("b.frame")).select(F.col("a.frame").alias("frame"), F.col("a.det").alias("det"), F.col("b.det").alias("found"), F.round(iou("a", "b"), 9).alias("iou")).filter("iou >= 0.10")
    best = met.groupBy("frame", "det").agg(F.max_by(F.struct("found", "iou"), F.struct("iou", -F.col("found"))).alias("m"))
    return box.filter("kind = 'N'").select("frame", "det").join(best, ["frame", "det"], "left").select("frame", "det", "m.found", F.round("m.iou", 6).alias("iou"))


@query(f" SELECT b.frame AS frame, b.det AS det FROM box b WHERE b.kind = 'A' AND NOT EXISTS (SELECT 1 FROM box a WHERE a.frame = b.frame AND a.kind <> 'A' AND {_iou} > 0.3)", "box")
def jn26_tiles_without_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN26, JN17: detections that no base detection overlaps."""
    box = views.box(spark, sf_dir)
    b, a = box.filter("kind = 'A'").alias("b"), box.filter("kind <> 'A'").alias("a")
    return b.join(a, (F.col("a.frame") == F.col("b.frame")) & (iou("a", "b") > 0.3), "left_anti").select("frame", "det")


@query(", t AS (SELECT frame % 97 AS clip, frame, det, (x2 - x1) * (y2 - y1) AS area, CAST(y1 AS INTEGER) % 5 AS track FROM box), g AS (SELECT clip, track, max(area) AS top, count(DISTINCT frame) AS n FROM t GROUP BY ALL), e AS (SELECT *, top >= 0.25 * max(top) OVER (PARTITION BY clip) AND n >= 3 AS good, row_number() OVER (PARTITION BY clip ORDER BY top DESC, track) AS k FROM g) SELECT clip, track, top, n, good AS by_rule FROM (SELECT *, bool_or(good) OVER (PARTITION BY clip) AS any_good FROM e) WHERE good OR (NOT any_good AND k = 1)", "box")
def ag37_enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG37, JN18, ST06: tracks of a quarter of the largest area and three frames at least; else the largest alone."""
    t = views.box(spark, sf_dir).select(F.expr("frame % 97 AS clip"), "frame", F.expr("(x2 - x1) * (y2 - y1) AS area"), F.expr("cast(y1 AS int) % 5 AS track"))
    g = t.groupBy("clip", "track").agg(F.max("area").alias("top"), F.countDistinct("frame").alias("n"))
    per = W.partitionBy("clip")
    e = g.withColumn("good", (F.col("top") >= 0.25 * F.max("top").over(per)) & (F.col("n") >= 3)).withColumn("k", F.row_number().over(per.orderBy(F.desc("top"), "track")))
    e = e.withColumn("some", F.bool_or("good").over(per)).filter("good OR (NOT some AND k = 1)")
    return e.select("clip", "track", "top", "n", F.col("good").alias("by_rule"))


@query(" SELECT CAST(x1 AS INTEGER) % 5 AS track, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, round(avg(score), 6) AS mean_score FROM box WHERE score < 0.95 GROUP BY 1", "box")
def ag36_refusal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG36, ST08: first and last frame and number of refusals by track."""
    return views.box(spark, sf_dir).filter("score < 0.95").groupBy(F.expr("cast(x1 AS int) % 5 AS track")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(", k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score * (x2 - x1) DESC, frame, det) AS r FROM box) SELECT kind, frame, det, round(score * (x2 - x1), 6) AS worth FROM k WHERE r = 1", "box")
def ag20_best_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20: the best frame of each slot by confidence times size; the first of equals."""
    worth = F.col("score") * (F.col("x2") - F.col("x1"))
    best = views.box(spark, sf_dir).groupBy("kind").agg(F.max_by(F.struct("frame", "det", worth.alias("w")), F.struct(worth, -F.col("frame"), -F.col("det"))).alias("m"))
    return best.select("kind", "m.frame", "m.det", F.round("m.w", 6).alias("worth"))


@query(", g AS (SELECT frame, det, least(640.0 / (x2 - x1), 640.0 / (y2 - y1)) AS r, x1, y1, x2, y2 FROM box) SELECT frame, det, round(r, 6) AS ratio, round((640 - (x2 - x1) * r) / 2, 6) AS pad_x, round((640 - (y2 - y1) * r) / 2, 6) AS pad_y FROM g", "box")
def fn22_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN22: scale and padding that fit each crop into a square canvas."""
    g = views.box(spark, sf_dir).withColumn("r", F.expr("least(640.0D / (x2 - x1), 640.0D / (y2 - y1))"))
    return g.select("frame", "det", F.round("r", 6).alias("ratio"), F.expr("round((640 - (x2 - x1) * r) / 2, 6) AS pad_x"), F.expr("round((640 - (y2 - y1) * r) / 2, 6) AS pad_y"))


@query(", f AS (SELECT frame, CAST(max(x2) AS INTEGER) AS w, CAST(max(y2) AS INTEGER) AS h FROM box GROUP BY frame) SELECT frame, CAST(least(i * 192, greatest(0, w - 256)) AS INTEGER) AS x, CAST(least(j * 192, greatest(0, h - 256)) AS INTEGER) AS y FROM f, unnest(generate_series(0, CAST(greatest(0, ceil((w - 256) / 192.0)) AS BIGINT))) a(i), unnest(generate_series(0, CAST(greatest(0, ceil((h - 256) / 192.0)) AS BIGINT))) b(j)", "box")
def fn23_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN23: overlapping tiles of 256 that cover each frame, of whatever size."""
    return tiles(views.box(spark, sf_dir))


def tiles(box: DataFrame) -> DataFrame:
    """(frame, x, y): corners of the tiles, 192 apart, the last against the edge."""
    f = box.groupBy("frame").agg(F.max("x2").cast("int").alias("w"), F.max("y2").cast("int").alias("h"))
    last = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - 256) / 192.0)).cast("int")
    f = f.withColumn("i", F.explode(F.sequence(F.lit(0), last("w")))).withColumn("j", F.explode(F.sequence(F.lit(0), last("h"))))
    at = lambda k, c: F.least(F.col(k) * 192, F.greatest(F.lit(0), F.col(c) - 256)).cast("int")
    return f.select("frame", at("i", "w").alias("x"), at("j", "h").alias("y"))


_nms = """, b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det) AS k FROM box),
nms(frame, k, kept) AS (
  SELECT frame, k, [{'det': det, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] FROM b WHERE k = 1
  UNION ALL
  SELECT n.frame, b.k, CASE WHEN len(list_filter(n.kept, lambda q: (greatest(least(q.x2, b.x2) - greatest(q.x1, b.x1), 0) * greatest(least(q.y2, b.y2) - greatest(q.y1, b.y1), 0))
      / ((q.x2 - q.x1) * (q.y2 - q.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(q.x2, b.x2) - greatest(q.x1, b.x1), 0) * greatest(least(q.y2, b.y2) - greatest(q.y1, b.y1), 0)) > 0.3)) > 0
    THEN n.kept ELSE list_append(n.kept, {'det': b.det, 'score': b.score, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}) END
  FROM nms n JOIN b ON b.frame = n.frame AND b.k = n.k + 1),
last AS (SELECT frame, unnest(arg_max(kept, k)) AS q FROM nms GROUP BY frame)
SELECT frame, q.det AS det, q.score AS score FROM last"""


@query(_nms, "box")
def jn25_box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN25: non-maximum suppression, frame by frame."""
    return suppress(views.box(spark, sf_dir))


def suppress(box: DataFrame) -> DataFrame:
    """(frame, det, score) that stay: best score first, equals by number; a box stays if none kept overlaps it by three tenths."""
    fields = ["det", "score", "x1", "y1", "x2", "y2"]
    ranked = box.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), *fields))).alias("b"))
    inter = "(greatest(least(q.x2, b.x2) - greatest(q.x1, b.x1), 0D) * greatest(least(q.y2, b.y2) - greatest(q.y1, b.y1), 0D))"
    covers = f"{inter} / ((q.x2 - q.x1) * (q.y2 - q.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {inter}) > 0.3D"
    kept = F.expr(f"aggregate(b, slice(b, 1, 0), (kept, b) -> if(exists(kept, q -> {covers}), kept, array_append(kept, b)))")
    return ranked.select("frame", F.explode(kept).alias("k")).select("frame", "k.det", "k.score")
