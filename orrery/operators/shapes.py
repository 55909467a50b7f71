"""Shapes put over masks, and gates on what is rendered from them. Masks are pixel rows on a grid of 24 by 24 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.masks import PIXEL, bitmaps, of_kind
from orrery.plans.registry import query
from orrery.sources import views
from orrery.sources.views import table

#: Side of the grid, pad of a box, frames of history.
SIDE, PAD, HISTORY = 24, 1, 3

_two = ", raw AS (SELECT frame, y, x FROM px WHERE kind = 'raw'), out AS (SELECT frame, y, x FROM px WHERE kind = 'out'), grid AS (SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x FROM range(24) a(i), range(24) b(i))"


def raw_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the raw masks, which have gaps by themselves."""
    return of_kind(views.px(spark, sf_dir), "raw")


def boxes_of(mask: DataFrame) -> DataFrame:
    return mask.groupBy("frame").agg(F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x").alias("x1"), F.max("x").alias("x2"))


def spots(y1: str, y2: str, x1: str, x2: str) -> str:
    """The pixels of a box, one row each; never more than the grid holds."""
    return f"inline(flatten(transform(sequence({y1}, {y2}), i -> transform(sequence({x1}, {x2}), j -> named_struct('y', i, 'x', j)))))"


@query(
    _two + ", r AS (SELECT frame, y, min(x) AS a, max(x) AS b FROM raw GROUP BY ALL), c AS (SELECT frame, x, min(y) AS a, max(y) AS b FROM raw GROUP BY ALL),"
    " d AS (SELECT frame, y - x AS k, min(x) AS a, max(x) AS b FROM raw GROUP BY ALL), e AS (SELECT frame, y + x AS k, min(x) AS a, max(x) AS b FROM raw GROUP BY ALL)"
    " SELECT r.frame, grid.y, grid.x FROM r JOIN grid ON grid.y = r.y AND grid.x > r.a AND grid.x < r.b JOIN c ON c.frame = r.frame AND c.x = grid.x AND grid.y > c.a AND grid.y < c.b"
    " JOIN d ON d.frame = r.frame AND d.k = grid.y - grid.x AND grid.x > d.a AND grid.x < d.b JOIN e ON e.frame = r.frame AND e.k = grid.y + grid.x AND grid.x > e.a AND grid.x < e.b"
    " ANTI JOIN raw t ON t.frame = r.frame AND t.y = grid.y AND t.x = grid.x",
    "px",
)
def mk05_solidify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK05: places outside a mask that see it in all eight directions. Along each line its first and last pixel decide."""
    m = raw_mask(spark, sf_dir)
    out = m.groupBy("frame", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("b - a > 1").selectExpr("frame", "y", "explode(sequence(a + 1, b - 1)) AS x")
    for line, along in (("x", "y"), ("y - x", "x"), ("y + x", "x")):
        ends = m.groupBy("frame", F.expr(line).alias("k")).agg(F.min(along).alias("a"), F.max(along).alias("b"))
        out = out.withColumn("k", F.expr(line)).join(ends, ["frame", "k"]).filter(f"{along} > a and {along} < b").select(*PIXEL)
    return out.join(m, PIXEL, "left_anti")


_mitigated = (
    _two + ", b AS (SELECT frame, min(y) - 1 AS y1, max(y) + 1 AS y2, min(x) - 1 AS x1, max(x) + 1 AS x2 FROM raw GROUP BY frame), shape AS (SELECT b.frame, grid.y, grid.x FROM b JOIN grid ON y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2),"
    " f AS (SELECT DISTINCT frame FROM raw), late AS (SELECT f.frame, raw.y, raw.x FROM raw JOIN f ON f.frame BETWEEN raw.frame AND raw.frame + 2),"
    " u AS (SELECT frame, y, x, bool_or(s) AS shape, bool_or(l) AS late, bool_or(c) AS cur FROM (SELECT *, true AS s, false AS l, false AS c FROM shape UNION ALL SELECT *, false, true, false FROM late UNION ALL SELECT *, false, false, true FROM raw) GROUP BY ALL)"
)


@query(_mitigated + " SELECT frame, count(*) AS n, count(*) FILTER (shape) AS n_shape, count(*) FILTER (late) AS n_late, count(*) FILTER (cur) AS n_current, count(*) FILTER (cur AND NOT late) AS breaches FROM u GROUP BY frame", "px")
def mk06_mitigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK06, MK07 (box): shape, history and current mask united; the result may lack no current pixel (breaches is 0)."""
    return mitigated_counts(bitmaps(of_kind(views.px_rows(spark, sf_dir), "raw"), SIDE))


def mitigated_counts(m: DataFrame) -> DataFrame:
    """(frame, n, n_shape, n_late, n_current, breaches) of bitmaps (frame, rows): pixels of a padded box of the mask, of the last HISTORY masks
    and of the current one, united and apart. A frame meets HISTORY bitmaps, and no pixel is a row."""
    m = m.filter(bits("rows") + " > 0")
    seen = m.select(F.explode(F.sequence(F.col("frame"), F.col("frame") + HISTORY - 1)).alias("frame"), F.col("rows").alias("was"))
    late = seen.groupBy("frame").agg(*[F.bit_or(F.col("was")[k]).alias(f"r{k}") for k in range(SIDE)]).select("frame", F.array(*[f"r{k}" for k in range(SIDE)]).alias("late"))
    m = m.join(late, "frame").withColumn("across", F.expr("aggregate(rows, 0L, (s, v) -> s | v)"))
    # the padded box: all columns from the first that has a pixel to the last, in all such rows
    first, last = "length(bin(across & -across)) - 1", "length(bin(across)) - 1"
    m = m.selectExpr("*", f"greatest({first} - {PAD}, 0) AS x1", f"least({last} + {PAD}, {SIDE - 1}) AS x2", "array_min(filter(transform(rows, (v, y) -> if(v <> 0, y, null)), y -> y is not null)) AS y1", "array_max(filter(transform(rows, (v, y) -> if(v <> 0, y, null)), y -> y is not null)) AS y2")
    m = m.withColumn("shape", F.expr(f"transform(rows, (v, y) -> if(y between y1 - {PAD} and y2 + {PAD}, shiftleft(shiftleft(1L, x2 - x1 + 1) - 1, x1), 0L))"))
    either = "zip_with(zip_with(rows, late, (a, b) -> a | b), shape, (a, b) -> a | b)"
    return m.selectExpr("frame", f"{bits(either)} AS n", f"{bits('shape')} AS n_shape", f"{bits('late')} AS n_late", f"{bits('rows')} AS n_current", f"{bits('zip_with(rows, late, (a, b) -> a & ~b)')} AS breaches")


def bits(rows: str) -> str:
    return f"aggregate({rows}, 0L, (s, v) -> s + bit_count(v))"


@query(
    _two + ", b AS (SELECT frame, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM raw GROUP BY frame), p AS (SELECT b.*, grid.y, grid.x, 2 * grid.y - y1 - y2 AS dy, 2 * grid.x - x1 - x2 AS dx, y2 - y1 + 1 AS h, x2 - x1 + 1 AS w FROM b JOIN grid ON y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2)"
    " SELECT frame, y, x FROM p WHERE dy * dy * w * w + dx * dx * h * h <= h * h * w * w",
    "px",
)
def mk07_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK07 (ellipse): the pixels of the ellipse within a mask's box, in whole numbers."""
    p = boxes_of(raw_mask(spark, sf_dir)).selectExpr("frame", "y1 + y2 AS sy", "x1 + x2 AS sx", "y2 - y1 + 1 AS h", "x2 - x1 + 1 AS w", spots("y1", "y2", "x1", "x2"))
    return p.filter("(2 * y - sy) * (2 * y - sy) * w * w + (2 * x - sx) * (2 * x - sx) * h * h <= h * h * w * w").select(*PIXEL)


@query(
    _two + ", c AS (SELECT frame, avg(y) AS cy, avg(x) AS cx FROM raw GROUP BY frame), r AS (SELECT frame, CAST(floor(round((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 12, 6)) AS INTEGER) % 12 AS bin, sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) AS d FROM raw JOIN c USING (frame))"
    " SELECT frame, bin, round(max(d), 6) AS radius, round(max(d) / max(max(d)) OVER (PARTITION BY frame), 6) AS share FROM r WHERE d > 0.000001 GROUP BY frame, bin",
    "px",
)
def mk10_radius_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK10: the furthest pixel from the middle in each of twelve directions, also as a share of the furthest of all."""
    m = raw_mask(spark, sf_dir)
    c = m.groupBy("frame").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    at = "cast(floor(round((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 12, 6)) AS int) % 12 AS bin"
    r = m.join(c, "frame").selectExpr("frame", at, "sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) AS d").filter("d > 0.000001").groupBy("frame", "bin").agg(F.max("d").alias("d"))
    return r.selectExpr("frame", "bin", "round(d, 6) AS radius", "round(d / max(d) OVER (PARTITION BY frame), 6) AS share")


@query(
    _two + ", m AS (SELECT raw.frame, count(*) AS ink, count(o.x) AS held FROM raw LEFT JOIN out o ON o.frame = raw.frame AND o.y = raw.y AND o.x = raw.x GROUP BY raw.frame)"
    " SELECT count(*) AS frames, round(avg(held * 1.0 / ink), 6) AS mean_held, round(min(held * 1.0 / ink), 6) AS least_held, count(*) FILTER (held = 0) AS none_held, (SELECT max(frame) + 1 FROM px) - count(*) AS absent,"
    " CASE WHEN avg(held * 1.0 / ink) < 0.95 OR quantile_cont(held * 1.0 / ink, 0.05) < 0.75 THEN 'refuse' WHEN min(held * 1.0 / ink) < 0.9 THEN 'warn' ELSE 'pass' END AS verdict FROM m",
    "px",
)
def au10_ink_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU09, AU10: how much of the ink the mask holds: mean, least, frames with none and without ink; three outcomes."""
    px = views.px(spark, sf_dir)
    f = px.groupBy(*PIXEL).agg(F.bool_or(F.col("kind") == "raw").alias("ink"), F.bool_or(F.col("kind") == "out").alias("mask")).filter("ink")
    s = f.groupBy("frame").agg((F.count_if("mask") / F.count("*")).alias("s")).crossJoin(F.broadcast(views.frame_count(px)))  # one row
    verdict = F.when((F.avg("s") < 0.95) | (F.expr("percentile(s, 0.05)") < 0.75), "refuse").when(F.min("s") < 0.9, "warn").otherwise("pass")
    return s.agg(F.count("*").alias("frames"), F.round(F.avg("s"), 6).alias("mean_held"), F.round(F.min("s"), 6).alias("least_held"), F.count_if(F.col("s") == 0).alias("none_held"), (F.max("frames") - F.count("*")).alias("absent"), verdict.alias("verdict"))


@query(
    _two + ", e AS (SELECT a.frame, count(*) AS n, count(*) FILTER (a.y IN (0, 23) OR a.x IN (0, 23)) AS edge, count(o.frame) AS held FROM raw a LEFT JOIN out o ON o.frame = a.frame AND o.y = a.y AND o.x = a.x GROUP BY a.frame), k AS (SELECT frame, count(*) AS n FROM out GROUP BY frame)"
    " SELECT e.frame, e.n AS n_here, coalesce(k.n, 0) AS n_there, round(CAST(held AS DOUBLE) / (e.n + coalesce(k.n, 0) - held), 6) AS iou, round(CAST(edge AS DOUBLE) / e.n, 6) AS edge_share, k.n IS NOT NULL AS paired FROM e LEFT JOIN k ON k.frame = e.frame",
    "px",
)
def au12_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU12: a mask against its side file: frames on both sides, overlap, and the share on the border of the image."""
    f = views.px(spark, sf_dir).groupBy(*PIXEL).agg(F.bool_or(F.col("kind") == "raw").alias("a"), F.bool_or(F.col("kind") == "out").alias("b"))
    g = f.groupBy("frame").agg(
        F.count_if("a").alias("n_here"), F.count_if("b").alias("n_there"), F.count("*").alias("n"), F.expr("count_if(a AND b)").alias("both"), F.expr(f"count_if(a AND (y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1})))").alias("edge")
    )
    return g.filter("n_here > 0").selectExpr("frame", "n_here", "n_there", "round(both / n, 6) AS iou", "round(edge / n_here, 6) AS edge_share", "n_there > 0 AS paired")


@query(
    ", m AS (SELECT l_orderkey AS frame, l_returnflag AS arm, avg(((l_partkey % 8 - l_suppkey % 8) * (l_partkey % 8 - l_suppkey % 8))::DOUBLE) AS mse FROM lineitem GROUP BY ALL), p AS (SELECT arm, mse, CASE WHEN mse > 0 THEN 10 * log10(65025.0 / mse) END AS psnr FROM m)"
    " SELECT arm, count(*) AS frames, count(*) FILTER (mse = 0) AS infinite, round(avg(psnr), 5) AS mean_psnr, round(stddev_samp(psnr), 5) AS sd_psnr FROM p GROUP BY arm",
    "px",
)
def ag30_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG30: peak signal-to-noise ratio by arm; frames without error are counted apart. (Similarity of structure is not here.)"""
    d = F.expr("cast((l_partkey % 8 - l_suppkey % 8) * (l_partkey % 8 - l_suppkey % 8) AS double)")
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("arm")).agg(F.avg(d).alias("mse"))
    p = m.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(65025.0 / F.col("mse"))))
    return p.groupBy("arm").agg(F.count("*").alias("frames"), F.count_if(F.col("mse") == 0).alias("infinite"), F.round(F.avg("psnr"), 5).alias("mean_psnr"), F.round(F.stddev_samp("psnr"), 5).alias("sd_psnr"))


#: Declared inputs of a node by place: name, value where none is given.
DECLARED = [(0, "mode", "none"), (1, "finish", "plain"), (2, "metal", "tin"), (3, "seed_control", "fixed")]
_declared = ", d AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{v}')" for i, n, v in DECLARED) + ") AS t(pos, name, fallback))"


@query(_declared + " SELECT p_partkey AS node, name, coalesce(string_split(p_type, ' ')[pos + 1], fallback) AS value, pos < len(string_split(p_type, ' ')) AS given FROM part CROSS JOIN d", "edge")
def gr03_bound_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR03, GR11: values given by place take the names declared; what is not given takes its default."""
    declared = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.lit(v).alias("fallback")) for i, n, v in DECLARED])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.split("p_type", " ").alias("v"), F.explode(declared).alias("d"))
    return p.selectExpr("node", "d.name", "coalesce(get(v, d.pos), d.fallback) AS value", "d.pos < size(v) AS given")


@query(
    ", k AS (SELECT e.node, e.class, p.node AS source FROM edge e LEFT JOIN edge p ON p.node = e.parent AND NOT p.muted AND e.node <> p.node WHERE NOT e.muted)"
    " SELECT node, CASE WHEN source IS NULL THEN 'missing source' WHEN class = 'Brand#11' AND source % 2 = 1 THEN 'wrong binding' ELSE 'ok' END AS verdict, 'class=' || class || ';source=' || coalesce(CAST(source AS VARCHAR), '') AS prompt FROM k",
    "edge",
)
def gr09_prompt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR04, GR09: one prompt line per live node, with the rule that it breaks, if any."""
    e = views.edge(spark, sf_dir).filter("not muted")
    k = e.join(e.select(F.col("node").alias("source")), (F.col("source") == F.col("parent")) & (F.col("source") != F.col("node")), "left")
    verdict = "CASE WHEN source IS NULL THEN 'missing source' WHEN class = 'Brand#11' AND source % 2 = 1 THEN 'wrong binding' ELSE 'ok' END AS verdict"
    return k.selectExpr("node", verdict, "concat('class=', class, ';source=', coalesce(cast(source AS string), '')) AS prompt")


@query(" SELECT clip, max(n) AS people, CASE WHEN max(n) = 0 THEN 'skip' WHEN max(n) = 1 THEN 'single' ELSE 'many' END AS branch, count(*) FILTER (n = 0) AS empty_frames FROM frames GROUP BY clip", "frames")
def gr10_branch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR10: the branch that the number of people in a clip calls for."""
    g = views.frames(spark, sf_dir).groupBy("clip").agg(F.max("n").alias("people"), F.count_if(F.col("n") == 0).alias("empty_frames"))
    return g.withColumn("branch", F.when(F.col("people") == 0, "skip").when(F.col("people") == 1, "single").otherwise("many"))
