"""Scalar functions over observations. Expressions that read alike in both dialects are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.exprs import uniform
from orrery.plans.registry import query
from orrery.sources import views

_key = "replace(replace(p_name, ' ', '_'), '#', '')"


@query(f"SELECT p_partkey AS node, {_key} AS key FROM part")
def fn05_annotation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN05: keys of annotations: blanks and signs replaced."""
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr(_key).alias("key"))


_text = "concat(CAST(ord % 3 AS {0}), 'h ', CAST(ord % 60 AS {0}), 'm ', CAST(ord % 50 AS {0}), 's ', CAST(ord % 900 AS {0}), 'ms')"


@query(f""", t AS (SELECT ord, value, {_text.format('VARCHAR')} AS t FROM series),
m AS (SELECT ord, value, CAST(regexp_extract(t, '([0-9]+)h', 1) AS BIGINT) * 60 + CAST(regexp_extract(t, '([0-9]+)m ', 1) AS BIGINT) + CAST(regexp_extract(t, '([0-9]+)s ', 1) AS BIGINT) / 60.0
      + CAST(regexp_extract(t, '([0-9]+)ms', 1) AS BIGINT) / 60000.0 AS minutes FROM t)
SELECT ord, round(minutes, 6) AS minutes, CASE WHEN minutes > 0 THEN round(value / minutes * 60, 4) END AS per_hour FROM m""", "series")
def fn06_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN06: durations written as hours, minutes, seconds and milliseconds, and a drain for each hour of them."""
    t = views.series(spark, sf_dir).select("ord", "value", F.expr(_text.format("STRING")).alias("t"))
    part = lambda p: F.regexp_extract("t", p, 1).cast("long")
    m = t.withColumn("minutes", part("([0-9]+)h") * 60 + part("([0-9]+)m ") + part("([0-9]+)s ") / 60.0 + part("([0-9]+)ms") / 60000.0)
    return m.select("ord", F.round("minutes", 6).alias("minutes"), F.when(F.col("minutes") > 0, F.round(F.col("value") / F.col("minutes") * 60, 4)).alias("per_hour"))


@query(" SELECT ord, us - CAST(floor(value * 1000) AS BIGINT) * 1000 AS began, greatest(1, CAST(round_even(value / 10 * 25, 0) AS BIGINT)) AS frames FROM series", "series")
def fn08_began(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN08, FN09: when an iteration began, from its end and length; seconds as frames, one at least."""
    s = views.series(spark, sf_dir)
    frames = F.greatest(F.lit(1).cast("long"), F.bround(F.col("value") / 10 * 25, 0).cast("long"))
    return s.select("ord", (F.col("us") - F.floor(F.col("value") * 1000) * 1000).alias("began"), frames.alias("frames"))


@query(""", b AS (SELECT ord, value, min(value) OVER (PARTITION BY label) AS lo, max(value) OVER (PARTITION BY label) AS hi FROM series)
SELECT ord, CASE WHEN hi > lo THEN round(lo + round_even((value - lo) / (hi - lo) * 15, 0) / 15 * (hi - lo), 6) ELSE round(lo, 6) END AS level,
 CASE WHEN value > 0 THEN round(exp(round_even(ln(value) / ln(1.1), 0) * ln(1.1)), 6) END AS ladder FROM b""", "series")
def fn12_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN12, FN13: sixteen levels over a track's own range; sizes on a ladder of tenths."""
    per = W.partitionBy("label")
    b = views.series(spark, sf_dir).select("ord", "value", F.min("value").over(per).alias("lo"), F.max("value").over(per).alias("hi"))
    level = F.when(F.col("hi") > F.col("lo"), F.expr("round(lo + bround((value - lo) / (hi - lo) * 15, 0) / 15 * (hi - lo), 6)")).otherwise(F.round("lo", 6))
    return b.select("ord", level.alias("level"), F.expr("CASE WHEN value > 0 THEN round(exp(bround(ln(value) / ln(1.1D), 0) * ln(1.1D)), 6) END AS ladder"))


@query(""" SELECT a.ord, round(list_avg(list_transform(range(0, 4), lambda k: list_distance(a.v[16 * k + 1 : 16 * k + 16], b.v[16 * k + 1 : 16 * k + 16]))), 6) AS distance
FROM emb a JOIN emb b ON b.ord = a.ord + 1""", "emb")
def fn15_part_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN15: the mean over four parts of the distance between two vectors."""
    e = views.emb(spark, sf_dir)
    met = e.select("ord", "v").join(e.select((F.col("ord") - 1).alias("ord"), F.col("v").alias("w")), "ord")
    part = "sqrt(aggregate(zip_with(slice(v, 16 * k + 1, 16), slice(w, 16 * k + 1, 16), (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x))"
    return met.select("ord", F.expr(f"round(aggregate(transform(sequence(0, 3), k -> {part}), 0D, (s, x) -> s + x) / 4, 6) AS distance"))


_yaw = "degrees(atan2(x2 - x1, y2 - y1))"


@query(f" SELECT frame, det, round({_yaw}, 6) AS yaw, round(greatest(0, cos(radians({_yaw}))), 6) AS quality, round(x1 * cos(0.5) - y1 * sin(0.5), 6) AS rx, round(x1 * sin(0.5) + y1 * cos(0.5), 6) AS ry FROM box", "box")
def fn17_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16, FN17: an angle from two lengths, the quality that follows from it, and a rotated point."""
    b = views.box(spark, sf_dir)
    return b.selectExpr("frame", "det", f"round({_yaw}, 6) AS yaw", f"round(greatest(0D, cos(radians({_yaw}))), 6) AS quality", "round(x1 * cos(0.5D) - y1 * sin(0.5D), 6) AS rx", "round(x1 * sin(0.5D) + y1 * cos(0.5D), 6) AS ry")


_crop = ["greatest(0, least(640, floor((x1 + x2) / 2 - greatest(x2 - x1, (y2 - y1) / 3) * 0.6))) AS cx1", "greatest(0, least(640, ceil((x1 + x2) / 2 + greatest(x2 - x1, (y2 - y1) / 3) * 0.6))) AS cx2",
         "greatest(0, least(360, floor(y1))) AS cy1", "greatest(0, least(360, ceil(y1 + greatest(x2 - x1, (y2 - y1) / 3) * 1.2))) AS cy2"]
_whole = [f"CAST({c.rsplit(' AS ', 1)[0]} AS BIGINT) AS {c.rsplit(' AS ', 1)[1]}" for c in _crop]


@query(f" SELECT frame, det, {', '.join(_whole)} FROM box", "box")
def fn21_face_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN21: a square around the upper third of a box, on the canvas, in whole pixels."""
    return views.box(spark, sf_dir).selectExpr("frame", "det", *_whole)


@query(" SELECT ord, sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',')) AS digest FROM emb", "emb")
def fn26_array_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN26: the digest of a vector rounded to four places; no negative zero."""
    return views.emb(spark, sf_dir).select("ord", F.sha2(F.expr("array_join(transform(v, x -> cast(cast(round(x * 10000) AS bigint) AS string)), ',')"), 256).alias("digest"))


@query(""" SELECT node, to_json({'node': node, 'class': class, 'links': [parent, node]}) AS doc FROM edge""", "edge")
def fn27_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN27: rows as JSON with lists and plain numbers."""
    return views.edge(spark, sf_dir).select("node", F.to_json(F.expr("named_struct('node', node, 'class', class, 'links', array(parent, node))")).alias("doc"))


_garment = "regexp_replace(lower(trim(concat('  The ', p_type))), '^(a|an|the) +', '')"
_loose = "CASE WHEN {0} LIKE '%steel%' OR {0} LIKE '%tin%' OR {0} LIKE '%copper%' OR {0} LIKE '%nickel%' OR {0} LIKE '%brass%' THEN 'metal' ELSE 'other' END".format(_garment)


@query(f"SELECT p_partkey AS node, {_garment} AS garment, {_loose} AS kind, concat_ws(', ', CASE WHEN p_size > 25 THEN 'large' END, {_garment}) AS descriptor FROM part")
def fn28_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN28: attributes coerced: article stripped, loosened to a kind, joined to a descriptor."""
    return views.table(spark, sf_dir, "part").selectExpr("p_partkey AS node", f"{_garment} AS garment", f"{_loose} AS kind", f"concat_ws(', ', CASE WHEN p_size > 25 THEN 'large' END, {_garment}) AS descriptor")


@query(""", m AS (SELECT node, map_concat(MAP {'blur': 3, 'grow': CAST(node % 4 AS INTEGER)}, MAP {'grow': 9, 'pad': CAST(node % 7 AS INTEGER)}) AS m FROM edge)
SELECT node, m['blur'] AS blur, m['grow'] AS grow, m['pad'] AS pad, CAST(cardinality(m) AS INTEGER) AS n FROM m""", "edge")
def fn30_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN30, FN32: a level's knobs filled with a preset's, which win."""
    level, preset = F.expr("map('blur', 3, 'grow', cast(node % 4 AS int))"), F.expr("map('grow', 9, 'pad', cast(node % 7 AS int))")
    m = views.edge(spark, sf_dir).select("node", F.map_zip_with(level, preset, lambda k, a, b: F.coalesce(b, a)).alias("m"))
    return m.select("node", *[F.col("m")[k].alias(k) for k in ("blur", "grow", "pad")], F.size("m").alias("n"))


_json = "concat('{{\"a\": {{\"', CASE WHEN node % 5 = 0 THEN 'password' ELSE 'colour' END, '\": [', CAST(node AS {0}), ']}}}}')"


@query(f" SELECT node, regexp_matches({_json.format('VARCHAR')}, '\"(password|secret)\" *:') AS forbidden FROM edge", "edge")
def fn31_forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN31: forbidden keys at any depth of a document."""
    return views.edge(spark, sf_dir).select("node", F.expr(f"""{_json.format('STRING')} rlike '"(password|secret)" *:' AS forbidden"""))


_mat = "2 + ord % 3 AS a, 1 AS b, 5 AS c, 0.5 AS d, 3 + ord % 2 AS e, 7 AS f"
_inv = ["round((e * (px - c) - b * (py - f)) / (a * e - b * d), 6) AS ix", "round((a * (py - f) - d * (px - c)) / (a * e - b * d), 6) AS iy"]


@query(f", m AS (SELECT ord, value AS x, 100 - value AS y, {_mat} FROM series), p AS (SELECT *, a * x + b * y + c AS px, d * x + e * y + f AS py FROM m) SELECT ord, round(px, 6) AS px, round(py, 6) AS py, {', '.join(_inv)} FROM p", "series")
def fn33_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN33: a point under an affine matrix, and back under its inverse."""
    m = views.series(spark, sf_dir).selectExpr("ord", "value AS x", "100 - value AS y", *[c.replace("0.5", "0.5D") for c in _mat.split(", ")])
    p = m.selectExpr("*", "a * x + b * y + c AS px", "d * x + e * y + f AS py")
    return p.selectExpr("ord", "round(px, 6) AS px", "round(py, 6) AS py", *_inv)


_smooth = "least(1, greatest(0, value / 100)) * least(1, greatest(0, value / 100)) * (3 - 2 * least(1, greatest(0, value / 100)))"


@query(f""", n AS (SELECT ord, value, lag(value) OVER w AS p, lead(value) OVER w AS q FROM series WINDOW w AS (PARTITION BY label ORDER BY us, ord))
SELECT ord, round({_smooth}, 6) AS step, CASE WHEN value > p AND value > q THEN round((p - q) / (2 * (p - 2 * value + q)), 6) END AS peak,
 round((0.25 * coalesce(p, value) + 0.5 * value + 0.25 * coalesce(q, value)), 6) AS smooth FROM n""", "series")
def fn34_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN34: a smooth step, the sub-sample place of a peak by a parabola, and a small kernel."""
    w = W.partitionBy("label").orderBy("us", "ord")
    n = views.series(spark, sf_dir).select("ord", "value", F.lag("value").over(w).alias("p"), F.lead("value").over(w).alias("q"))
    peak = "CASE WHEN value > p AND value > q THEN round((p - q) / (2 * (p - 2 * value + q)), 6) END AS peak"
    return n.selectExpr("ord", f"round({_smooth}, 6) AS step", peak, "round(0.25D * coalesce(p, value) + 0.5D * value + 0.25D * coalesce(q, value), 6) AS smooth")


@query(" SELECT kind, frame, y, x, CAST(('0x' || substr(md5(concat_ws('|', 'grain', frame, y, x)), 1, 8)) AS BIGINT) / 4294967296.0 AS grain, greatest(500, least(8000, 40 * x * y)) AS rate FROM px", "px")
def fn35_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN35, FN36: grain that follows from the place alone, and a rate within its bounds."""
    return views.px(spark, sf_dir).select("kind", "frame", "y", "x", uniform(F.lit("grain"), F.col("frame"), F.col("y"), F.col("x")).alias("grain"), F.expr("greatest(500, least(8000, 40 * x * y)) AS rate"))


@query(""", c AS (SELECT frame, y, x FROM px WHERE kind = 'out'), g AS (SELECT f.frame, y, x FROM (SELECT DISTINCT frame FROM c) f, generate_series(0, 23) a(y), generate_series(0, 23) b(x)),
l AS (SELECT g.frame, count(*) FILTER (c.y = g.y AND c.x = g.x) * -4 + count(*) FILTER (c.y IS NOT NULL AND NOT (c.y = g.y AND c.x = g.x)) AS l
      FROM g LEFT JOIN c ON c.frame = g.frame AND abs(c.y - g.y) + abs(c.x - g.x) <= 1 GROUP BY g.frame, g.y, g.x)
SELECT frame, round(var_pop(l), 6) AS sharpness FROM l GROUP BY frame""", "px")
def fn37_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN37: the variance of the Laplacian. Each pixel sends what it adds to its four neighbours: one aggregation, no join."""
    c = views.px(spark, sf_dir).filter("kind = 'out'").select("frame", "y", "x")
    parts = F.expr("explode(array(struct(0 AS dy, 0 AS dx, -4 AS w), struct(1 AS dy, 0 AS dx, 1 AS w), struct(-1 AS dy, 0 AS dx, 1 AS w), struct(0 AS dy, 1 AS dx, 1 AS w), struct(0 AS dy, -1 AS dx, 1 AS w)))")
    l = c.withColumn("p", parts).groupBy("frame", (F.col("y") + F.col("p.dy")).alias("y"), (F.col("x") + F.col("p.dx")).alias("x")).agg(F.sum("p.w").alias("l"))
    l = l.filter("y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23").groupBy("frame").agg(F.sum("l").alias("s"), F.sum(F.col("l") * F.col("l")).alias("q"))
    return l.select("frame", F.expr("round(q / 576D - (s / 576D) * (s / 576D), 6) AS sharpness"))  # places not reached are zero


@query(""", e AS (SELECT clip, frame, max(x) FILTER (joint = 0) AS nx, max(y) FILTER (joint = 0) AS ny, max(x) FILTER (joint = 1) AS lx, max(y) FILTER (joint = 1) AS ly, max(x) FILTER (joint = 2) AS rx, max(y) FILTER (joint = 2) AS ry FROM pose GROUP BY clip, frame),
s AS (SELECT *, atan2(ry - ly, rx - lx) AS roll, sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)) AS span, (lx + rx) / 2 AS ox, (ly + ry) / 2 AS oy FROM e)
SELECT clip, frame, CASE WHEN span > 0 AND nx IS NOT NULL THEN round(((nx - ox) * cos(-roll) - (ny - oy) * sin(-roll)) / span, 6) ELSE 0 END AS u,
 CASE WHEN span > 0 AND nx IS NOT NULL THEN round(((nx - ox) * sin(-roll) + (ny - oy) * cos(-roll)) / span, 6) ELSE 0 END AS v FROM s""", "pose")
def fn40_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN40, FN41: the nose in a frame whose origin lies between the eyes, upright, in units of their distance; zeros without a face."""
    at = lambda j, c: F.max(F.when(F.col("joint") == j, F.col(c)))
    e = views.pose(spark, sf_dir).groupBy("clip", "frame").agg(*[at(j, c).alias(f"{n}{c}") for j, n in ((0, "n"), (1, "l"), (2, "r")) for c in "xy"])
    s = e.selectExpr("*", "atan2(ry - ly, rx - lx) AS roll", "sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)) AS span", "(lx + rx) / 2 AS ox", "(ly + ry) / 2 AS oy")
    face = (F.col("span") > 0) & F.col("nx").isNotNull()
    u, v = "round(((nx - ox) * cos(-roll) - (ny - oy) * sin(-roll)) / span, 6)", "round(((nx - ox) * sin(-roll) + (ny - oy) * cos(-roll)) / span, 6)"
    return s.select("clip", "frame", F.when(face, F.expr(u)).otherwise(F.lit(0.0)).alias("u"), F.when(face, F.expr(v)).otherwise(F.lit(0.0)).alias("v"))


_side = "CASE WHEN cx < 200 THEN 'left' WHEN cx > 400 THEN 'right' ELSE 'front' END"
_tone = "CASE WHEN r > b * 1.1 THEN 'warm' WHEN b > r * 1.1 THEN 'cool' ELSE 'even' END"


@query(f""", l AS (SELECT kind, avg(score * 255) AS r, avg((x2 - x1)) AS g, avg((y2 - y1)) AS b, sum(score * (x1 + x2) / 2) / sum(score) AS cx FROM box GROUP BY kind)
SELECT kind, round(cx, 6) AS centre, {_side} AS direction, {_tone} AS tone, printf('#%02x%02x%02x', CAST(floor(r) AS INTEGER), CAST(floor(g) AS INTEGER), CAST(floor(b) AS INTEGER)) AS colour FROM l""", "box")
def fn42_lighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN42: mean colour, the centre of light, and buckets of direction and tone."""
    l = views.box(spark, sf_dir).groupBy("kind").agg(F.avg(F.col("score") * 255).alias("r"), F.avg(F.expr("x2 - x1")).alias("g"), F.avg(F.expr("y2 - y1")).alias("b"), F.expr("sum(score * (x1 + x2) / 2) / sum(score) AS cx"))
    colour = F.format_string("#%02x%02x%02x", *[F.floor(c).cast("int") for c in "rgb"])
    return l.select("kind", F.round("cx", 6).alias("centre"), F.expr(_side).alias("direction"), F.expr(_tone).alias("tone"), colour.alias("colour"))


_spec = "concat(CASE WHEN p_size % 3 = 0 THEN 'full' ELSE 'hold' END, CASE WHEN p_size % 2 = 0 THEN concat('@', CAST(p_size AS {0})) ELSE '' END)"


@query(f"""WITH s AS (SELECT p_partkey AS node, string_split({_spec.format('VARCHAR')}, '@') AS s, [p_brand, p_type] AS asked, p_type FROM part)
SELECT node, s[1] AS mode, CASE WHEN len(s) > 1 THEN CAST(s[2] AS INTEGER) ELSE 30 END AS win, s[1] = 'full' AND len(s) > 1 AS head, len(list_filter(asked, lambda x: NOT list_contains(['Brand#11', 'Brand#22', p_type], x))) = 0 AS allowed FROM s""")
def fn43_arm_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN43, FN44: a specification's parts with their defaults; names outside the allow-list are refused."""
    s = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.split(F.expr(_spec.format("STRING")), "@").alias("s"), F.array("p_brand", "p_type").alias("asked"), "p_type")
    unknown = F.array_except("asked", F.array(F.lit("Brand#11"), F.lit("Brand#22"), F.col("p_type")))
    win = F.when(F.size("s") > 1, F.try_element_at("s", F.lit(2)).cast("int")).otherwise(F.lit(30))
    return s.select("node", F.col("s")[0].alias("mode"), win.alias("win"), ((F.col("s")[0] == "full") & (F.size("s") > 1)).alias("head"), (F.size(unknown) == 0).alias("allowed"))


@query(""", size AS (SELECT DISTINCT class, min(node) OVER (PARTITION BY class) AS w FROM edge WHERE muted) SELECT node, coalesce(w, 640) AS width FROM edge LEFT JOIN size ON size.class = edge.class""", "edge")
def fn45_frame_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN45, JN20: a size for each key, else the size for all."""
    e = views.edge(spark, sf_dir)
    return e.join(e.filter("muted").groupBy("class").agg(F.min("node").alias("w")), "class", "left").select("node", F.coalesce("w", F.lit(640)).alias("width"))
