"""Audits of leaks and bundles, and the mask morphology that they rest on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.masks import bitmaps, of_kind, window
from orrery.plans.registry import query
from orrery.sources import views

_raw = ", raw AS (SELECT frame, y, x FROM px WHERE kind = 'raw'), cover AS (SELECT frame, y, x FROM px WHERE kind = 'out')"
#: All bits of a row of the canvas.
CANVAS = 2**24 - 1
AROUND = "explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS dy, j AS dx)))))"


def kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = views.px(spark, sf_dir)
    return tuple(px.filter(f"kind = '{k}'").select("frame", "y", "x") for k in ("raw", "out"))


def counted(mask: DataFrame) -> DataFrame:
    """(frame, y, x, n) on the canvas: how many pixels of the mask lie at a place or next to it."""
    near = mask.withColumn("o", F.expr(AROUND)).select("frame", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return near.filter("y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23").groupBy("frame", "y", "x").agg(F.count("*").alias("n"))


def dilate(mask: DataFrame) -> DataFrame:
    return counted(mask).select("frame", "y", "x")


def erode(mask: DataFrame) -> DataFrame:
    """Places all of whose nine places are in the mask (beyond the canvas nothing is)."""
    return counted(mask).filter("n = 9").select("frame", "y", "x")


_near = "SELECT m.frame, CAST(m.y + dy AS INTEGER) AS y, CAST(m.x + dx AS INTEGER) AS x, count(*) AS n FROM {0} m, generate_series(-1, 1) a(dy), generate_series(-1, 1) b(dx) WHERE m.y + dy BETWEEN 0 AND 23 AND m.x + dx BETWEEN 0 AND 23 GROUP BY 1, 2, 3"
_open = _raw + f""", e AS (SELECT frame, y, x FROM ({_near.format('raw')}) WHERE n = 9), o AS (SELECT frame, y, x FROM ({_near.format('e')})),
d AS (SELECT frame, y, x FROM ({_near.format('raw')})), c AS (SELECT frame, y, x FROM ({_near.format('d')}) WHERE n = 9)
SELECT 'erode' AS step, frame, count(*) AS pixels FROM e GROUP BY frame UNION ALL SELECT 'open', frame, count(*) FROM o GROUP BY frame UNION ALL SELECT 'close', frame, count(*) FROM c GROUP BY frame"""


@query(_open, "px")
def mk03_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK03: erosion, opening and closing by a square of three: pixels left by frame. Bitmaps are shifted, so a frame is a row."""
    m = bitmaps(of_kind(views.px_rows(spark, sf_dir), "raw"))

    def grown(rows: Column) -> Column:
        wide = F.transform(rows, lambda v: F.shiftleft(v, 1).bitwiseOR(v).bitwiseOR(F.shiftright(v, 1)).bitwiseAND(F.lit(CANVAS)))
        return upright(wide, lambda a, b: a.bitwiseOR(b))

    def shrunk(rows: Column) -> Column:
        wide = F.transform(rows, lambda v: F.shiftleft(v, 1).bitwiseAND(v).bitwiseAND(F.shiftright(v, 1)))
        return upright(wide, lambda a, b: a.bitwiseAND(b))

    def upright(rows: Column, both: Callable[[Column, Column], Column]) -> Column:
        none = F.lit(0).cast("long")
        at = lambda i: F.coalesce(F.get(rows, i), none)
        return F.transform(rows, lambda v, i: both(both(at(i - 1), v), at(i + 1)))

    # each step a column of its own, which the next one reads
    m = m.withColumn("e", shrunk(F.col("rows"))).withColumn("d", grown(F.col("rows")))
    m = m.withColumn("o", grown(F.col("e"))).withColumn("c", shrunk(F.col("d")))
    n = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + F.bit_count(v))
    steps = F.array(*[F.struct(F.lit(k).alias("step"), n(c).alias("pixels")) for k, c in (("erode", "e"), ("open", "o"), ("close", "c"))])
    return m.select("frame", F.explode(steps).alias("s")).select("s.step", "frame", "s.pixels").filter("pixels > 0")


_edge = "SELECT m.frame, m.y, m.x FROM {0} m WHERE (SELECT count(*) FROM {0} q WHERE q.frame = m.frame AND abs(q.y - m.y) + abs(q.x - m.x) = 1) < 4"


@query(_raw + f""", a AS ({_edge.format('raw')}), b AS ({_edge.format('cover')}),
p AS (SELECT frame, avg(CAST(EXISTS (SELECT 1 FROM a WHERE a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) AS DOUBLE)) AS p FROM b GROUP BY frame),
r AS (SELECT frame, avg(CAST(EXISTS (SELECT 1 FROM b WHERE b.frame = a.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) AS DOUBLE)) AS r FROM a GROUP BY frame)
SELECT p.frame, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM p JOIN r ON r.frame = p.frame""", "px")
def mk01_boundary_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK01: how well two outlines agree within one pixel."""

    def edge(mask: DataFrame) -> DataFrame:
        steps = F.expr("explode(array(struct(1 AS dy, 0 AS dx), struct(-1 AS dy, 0 AS dx), struct(0 AS dy, 1 AS dx), struct(0 AS dy, -1 AS dx)))")
        near = mask.withColumn("o", steps).select("frame", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).groupBy("frame", "y", "x").agg(F.count("*").alias("n"))
        return mask.join(near.filter("n = 4"), ["frame", "y", "x"], "left_anti")

    def share(mask: DataFrame, other: DataFrame, name: str) -> DataFrame:
        met = mask.join(counted(other), ["frame", "y", "x"], "left")
        return met.groupBy("frame").agg(F.avg(F.col("n").isNotNull().cast("double")).alias(name))

    raw, cover = (edge(m) for m in kinds(spark, sf_dir))
    both = share(cover, raw, "p").join(share(raw, cover, "r"), "frame")
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return both.select("frame", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f, 6).alias("f"))


@query(_raw + """, heat AS (SELECT y, x, count(*) AS n FROM raw GROUP BY y, x),
r AS (SELECT h.y, h.x, max(q.n) - min(q.n) AS range FROM heat h JOIN heat q ON abs(q.y - h.y) <= 1 AND abs(q.x - h.x) <= 1 GROUP BY h.y, h.x) SELECT y, x, range FROM r""", "px")
def mk13_local_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK13: the greatest less the least within a pixel, of how often each place is painted."""
    raw, _ = kinds(spark, sf_dir)
    heat = raw.groupBy("y", "x").agg(F.count("*").alias("n"))
    near = heat.withColumn("o", F.expr(AROUND)).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "n").groupBy("y", "x").agg((F.max("n") - F.min("n")).alias("range"))
    return near.join(heat.select("y", "x"), ["y", "x"])


@query(_raw + """, d AS (SELECT * FROM ((SELECT * FROM raw EXCEPT SELECT * FROM cover) UNION ALL (SELECT * FROM cover EXCEPT SELECT * FROM raw))),
e AS (SELECT frame, min(x) AS lo, max(x) AS hi, max(y) AS floor FROM raw GROUP BY frame)
SELECT d.frame, count(*) AS painted, count(*) FILTER (x BETWEEN lo AND hi AND y <= least(23, floor + 2)) AS inside FROM d JOIN e ON e.frame = d.frame GROUP BY d.frame""", "px")
def mk12_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK12, MK14: pixels that differ between two masks, and those within the observed extent with its floor lowered by two."""
    raw, cover = kinds(spark, sf_dir)
    d = raw.exceptAll(cover).unionByName(cover.exceptAll(raw))
    e = raw.groupBy("frame").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("y").alias("floor"))
    inside = F.expr("x BETWEEN lo AND hi AND y <= least(23, floor + 2)")
    return d.join(e, "frame").groupBy("frame").agg(F.count("*").alias("painted"), F.count_if(inside).alias("inside"))


_cover = """, b AS (SELECT frame, det, CAST(frame // 375 AS INTEGER) AS f, kind, CAST(x1 AS INTEGER) % 24 AS bx, CAST(y1 AS INTEGER) % 24 AS "by" FROM box),
m AS (SELECT frame, y, x FROM px WHERE kind = 'out'), c AS (SELECT b.frame, b.det, b.kind, 1 - count(m.x) / 16.0 AS shown FROM b LEFT JOIN m ON m.frame = b.f AND m.x >= bx AND m.x < bx + 4 AND m.y >= "by" AND m.y < "by" + 4 GROUP BY ALL)"""
_bucket = "CASE kind WHEN 'N' THEN 'enrolled' WHEN 'A' THEN 'refused' ELSE 'unknown' END"


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, det, kind, shown): the share of each box that the mask leaves bare. A box is joined once with its mask's bitmap."""
    b = views.box(spark, sf_dir).selectExpr("frame", "det", f"cast(frame div {views.ORDERS} AS int) AS f", "kind", "cast(x1 AS int) % 24 AS bx", "cast(y1 AS int) % 24 AS by")
    m = bitmaps(of_kind(views.px_rows(spark, sf_dir), "out")).withColumnRenamed("frame", "f")
    return b.join(m, "f", "left").selectExpr("frame", "det", "kind", f"1 - ({window('rows', 'by', 'bx', 4, 4)}) / 16.0D AS shown")


@query(_cover + f" SELECT {_bucket} AS bucket, count(*) AS n, count(*) FILTER (shown > 0.05) AS over5, count(*) FILTER (shown > 0.5) AS over50, bool_or(shown >= 0.9) AS control FROM c GROUP BY 1", "box", "px")
def au02_reveals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU02: boxes of which over a twentieth and over half is bare, by what is known of the person; the control must find some."""
    rows = shown(spark, sf_dir).groupBy(F.expr(_bucket).alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("shown") > 0.05).alias("over5"), F.count_if(F.col("shown") > 0.5).alias("over50"), F.bool_or(F.col("shown") >= 0.9).alias("control"))


@query(_cover + f""", f AS (SELECT median(m) AS fill FROM (SELECT kind, frame // 375 AS g, median(shown) AS m FROM c GROUP BY 1, 2))
SELECT {_bucket} AS bucket, round(any_value(fill), 6) AS fill, count(*) FILTER (shown > fill + 0.05) AS above FROM c, f GROUP BY 1""", "box", "px")
def au03_reveals_by_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU03: the same against a level found from the data: the median of medians."""
    c = shown(spark, sf_dir)
    fill = c.groupBy("kind", F.expr(f"frame div {views.ORDERS} AS g")).agg(F.median("shown").alias("m")).agg(F.median("m").alias("fill"))  # one row
    rows = c.crossJoin(F.broadcast(fill)).groupBy(F.expr(_bucket).alias("bucket"))
    return rows.agg(F.round(F.first("fill"), 6).alias("fill"), F.count_if(F.col("shown") > F.col("fill") + 0.05).alias("above"))


@query(_raw + f""", u AS (SELECT * FROM raw EXCEPT SELECT * FROM cover), near AS ({_near.format('cover')}), inner_u AS (SELECT frame, y, x FROM ({_near.format('u')}) WHERE n = 9)
SELECT r.frame, r.n AS raw, coalesce(u.n, 0) AS uncovered, coalesce(k.n, 0) AS flat, coalesce(w.n, 0) AS beside, round(coalesce(u.n, 0) / CAST(r.n AS DOUBLE), 6) AS share
FROM (SELECT frame, count(*) AS n FROM raw GROUP BY frame) r LEFT JOIN (SELECT frame, count(*) AS n FROM u GROUP BY frame) u ON u.frame = r.frame
LEFT JOIN (SELECT frame, count(*) AS n FROM inner_u GROUP BY frame) k ON k.frame = r.frame
LEFT JOIN (SELECT u.frame, count(*) AS n FROM u JOIN near q ON q.frame = u.frame AND q.y = u.y AND q.x = u.x GROUP BY u.frame) w ON w.frame = r.frame""", "px")
def au05_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU05, AU06: raw pixels left bare by frame, those in solid patches, and those next to the cover."""
    raw, cover = kinds(spark, sf_dir)
    on = ["frame", "y", "x"]
    u = raw.join(cover.withColumn("hid", F.lit(True)), on, "left").join(counted(cover).withColumnRenamed("n", "near"), on, "left")
    counts = u.groupBy("frame").agg(F.count("*").alias("raw"), F.count_if(F.col("hid").isNull()).alias("uncovered"), F.count_if(F.col("hid").isNull() & F.col("near").isNotNull()).alias("beside"))
    flat = erode(u.filter("hid is null").select(*on)).groupBy("frame").agg(F.count("*").alias("flat"))
    out = counts.join(flat, "frame", "left").fillna(0, ["flat"])
    return out.select("frame", "raw", "uncovered", "flat", "beside", F.round(F.col("uncovered") / F.col("raw"), 6).alias("share"))


@query(""", h AS (SELECT kind, frame, x * 32 // 24 AS bin, count(*) AS n FROM px GROUP BY ALL),
t AS (SELECT kind, frame, sum(n) AS total, sum(CASE WHEN r <= 2 THEN n END) AS top FROM (SELECT *, row_number() OVER (PARTITION BY kind, frame ORDER BY n DESC, bin) AS r FROM h) GROUP BY kind, frame)
SELECT kind, count(*) AS frames, bool_and(top / total >= 0.10) AS passes, count(*) FILTER (top / total < 0.10) AS refused, round(min(top / total), 6) AS least FROM t GROUP BY kind""", "px")
def au14_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU14: the share of the two fullest of 32 bins; every frame must pass, none is diluted by others."""
    h = views.px(spark, sf_dir).groupBy("kind", "frame", F.expr("x * 32 div 24 AS bin")).agg(F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("kind", "frame").orderBy(F.desc("n"), "bin"))
    t = h.withColumn("r", r).groupBy("kind", "frame").agg((F.sum(F.when(F.col("r") <= 2, F.col("n"))) / F.sum("n")).alias("share"))
    return t.groupBy("kind").agg(F.count("*").alias("frames"), F.bool_and(F.col("share") >= 0.10).alias("passes"), F.count_if(F.col("share") < 0.10).alias("refused"), F.round(F.min("share"), 6).alias("least"))


@query(""" SELECT kind, frame, round(stddev_pop(x), 6) AS spread, round((max(x) - min(x) + 1.0) / (max(y) - min(y) + 1.0), 6) AS aspect,
 stddev_pop(x) >= 1 AND (max(x) - min(x) + 1.0) / (max(y) - min(y) + 1.0) BETWEEN 0.5 AND 2 AS sane FROM px GROUP BY kind, frame""", "px")
def au15_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU15: a generated image must vary and must not be a sliver."""
    rows = views.px(spark, sf_dir).groupBy("kind", "frame").agg(F.stddev_pop("x").alias("s"), F.expr("(max(x) - min(x) + 1.0D) / (max(y) - min(y) + 1.0D)").alias("a"))
    return rows.select("kind", "frame", F.round("s", 6).alias("spread"), F.round("a", 6).alias("aspect"), ((F.col("s") >= 1) & F.col("a").between(0.5, 2)).alias("sane"))


@query(""", f AS (SELECT frame % 8 AS clip, frame, count(*) FILTER (kind = 'out') AS alpha, count(*) FILTER (kind = 'raw') AS key FROM px GROUP BY frame),
s AS (SELECT clip, count(*) FILTER (alpha >= 60) AS good, count(*) AS n FROM f GROUP BY clip),
c AS (SELECT clip, CASE WHEN good * 5 >= n * 4 THEN 'alpha' ELSE 'key' END AS source FROM s)
SELECT f.clip, frame, source, CASE source WHEN 'alpha' THEN alpha ELSE key END AS pixels, NOT (CASE source WHEN 'alpha' THEN alpha ELSE key END BETWEEN 30 AND 500) AS refused FROM f JOIN c ON c.clip = f.clip""", "px")
def au17_author_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU17: the source of alpha is chosen once for a clip; frames out of its bands are refused."""
    f = views.px(spark, sf_dir).groupBy("frame").agg(F.count_if(F.col("kind") == "out").alias("alpha"), F.count_if(F.col("kind") == "raw").alias("key")).withColumn("clip", F.expr("frame % 8"))
    c = f.groupBy("clip").agg(F.expr("if(count_if(alpha >= 60) * 5 >= count(*) * 4, 'alpha', 'key') AS source"))
    pixels = F.expr("if(source = 'alpha', alpha, key)")
    return f.join(c, "clip").select("clip", "frame", "source", pixels.alias("pixels"), (~pixels.between(30, 500)).alias("refused"))


@query(_raw + """, n AS (SELECT frame, count(*) FILTER (kind = 'raw') AS r, count(*) FILTER (kind = 'out') AS c FROM px GROUP BY frame),
u AS (SELECT frame, count(*) AS escaped FROM (SELECT * FROM raw EXCEPT SELECT * FROM cover) GROUP BY frame)
SELECT count(*) AS frames, count(escaped) AS violations, CAST(coalesce(sum(escaped), 0) AS BIGINT) AS pixels, round(avg(CAST(c AS DOUBLE) / r), 6) AS ratio, round(avg(CAST(c AS DOUBLE)) - avg(CAST(r AS DOUBLE)), 6) AS delta FROM n LEFT JOIN u ON u.frame = n.frame WHERE r > 0""", "px")
def au26_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU26, AU25, AU08: frames and pixels that escape the cover, and what the cover costs in area against the raw arm."""
    raw, cover = kinds(spark, sf_dir)
    n = views.px(spark, sf_dir).groupBy("frame").agg(F.count_if(F.col("kind") == "raw").alias("r"), F.count_if(F.col("kind") == "out").alias("c")).filter("r > 0")
    u = raw.exceptAll(cover).groupBy("frame").agg(F.count("*").alias("escaped"))
    rows = n.join(u, "frame", "left")
    return rows.agg(F.count("*").alias("frames"), F.count("escaped").alias("violations"), F.coalesce(F.sum("escaped"), F.lit(0)).alias("pixels"), F.round(F.avg(F.col("c") / F.col("r")), 6).alias("ratio"), F.round(F.avg("c") - F.avg("r"), 6).alias("delta"))


@query(
    """ SELECT target, coalesce(array_to_string(list_sort(list(DISTINCT p_type) FILTER (s IS NULL)), ','), '') AS missing, count(DISTINCT p_type) AS needs, count(DISTINCT p_type) FILTER (s IS NULL) = 0 AS ready
FROM (SELECT p_brand AS target, p_type, s FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49) ON s = p_partkey) GROUP BY target"""
)
def au27_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU27: targets (brands), the inputs that each needs (types of its parts), and those that are not there (parts never returned in bulk)."""
    have = views.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 49").select(F.col("l_partkey").alias("s")).distinct()
    needs = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("target"), "p_type", F.col("p_partkey").alias("k"))
    lacks = F.when(F.col("s").isNull(), F.col("p_type"))
    rows = needs.join(have, F.col("k") == F.col("s"), "left").groupBy("target")
    missing = F.array_sort(F.collect_set(lacks))
    out = rows.agg(missing.alias("m"), F.countDistinct("p_type").alias("needs"))
    return out.select("target", F.array_join("m", ",").alias("missing"), "needs", (F.size("m") == 0).alias("ready"))
