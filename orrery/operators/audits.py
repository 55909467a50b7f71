"""Audits and gates: every rule gives rows that say what passed and what did not; the strict form stops the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.masks import bitmaps, of_kind, window
from orrery.plans.registry import query
from orrery.sources import views
from orrery.sources.views import table


def strict(df: DataFrame, breach: Column, message: str) -> DataFrame:
    """FLT10, AU16, AU20: the same rows; the job fails on the first that breaks the rule."""
    return df.filter(F.when(breach, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


_cover = ", b AS (SELECT DISTINCT CAST(frame // 375 AS INTEGER) AS frame, det, CAST(x1 AS INTEGER) % 24 AS bx, CAST(y1 AS INTEGER) % 24 AS \"by\" FROM box), m AS (SELECT DISTINCT frame, y, x FROM px WHERE kind = 'out'), c AS (SELECT b.frame AS frame, det, bx, \"by\", count(m.x) AS n FROM b LEFT JOIN m ON m.frame = b.frame AND m.x >= bx AND m.x < bx + 4 AND m.y >= \"by\" AND m.y < \"by\" + 4 GROUP BY ALL)"


@query(_cover + " SELECT frame, count(*) AS boxes, count(*) FILTER (n < 8) AS uncovered, round(avg(n / 16.0), 6) AS coverage FROM c GROUP BY frame", "box", "px")
def au01_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU01: boxes of which the mask covers less than half. A box is joined once with its mask's bitmap."""
    b = views.box(spark, sf_dir).selectExpr(f"cast(frame div {views.ORDERS} AS int) AS frame", "det", "cast(x1 AS int) % 24 AS bx", "cast(y1 AS int) % 24 AS by").distinct()
    m = bitmaps(of_kind(views.px_rows(spark, sf_dir), "out"))
    c = b.join(m, "frame", "left").selectExpr("frame", f"{window('rows', 'by', 'bx', 4, 4)} AS n")
    return c.groupBy("frame").agg(F.count("*").alias("boxes"), F.count_if(F.col("n") < 8).alias("uncovered"), F.round(F.avg(F.col("n") / 16.0), 6).alias("coverage"))


@query(", t AS (SELECT ident, value / 100.0 AS cover FROM series) SELECT ident, count(*) AS n, round(avg(CAST(cover >= 1.0 AS DOUBLE)), 6) AS full_cover, round(avg(CAST(cover >= 0.95 AS DOUBLE)), 6) AS at95, round(avg(CAST(cover >= 0.5 AS DOUBLE)), 6) AS at50, count(*) FILTER (cover = 0) AS zero FROM t GROUP BY GROUPING SETS ((ident), ())", "series")
def au04_coverage_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU04, AG45: shares above thresholds by video and over all."""
    t = views.series(spark, sf_dir).selectExpr("ident", "value / 100.0D AS cover")
    rate = lambda k, n: F.round(F.avg((F.col("cover") >= k).cast("double")), 6).alias(n)
    return t.groupingSets([["ident"], []], "ident").agg(F.count("*").alias("n"), rate(1.0, "full_cover"), rate(0.95, "at95"), rate(0.5, "at50"), F.count_if(F.col("cover") == 0).alias("zero"))


@query(" SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def so05_identical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO05, FN25, SRC15: files with the same digest."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(" SELECT 'missing' AS problem, doc_id AS name FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL SELECT 'extra', doc_id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def jn17_file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17, SO04, AU07: required files that are not there, and files that nobody asked for."""
    have, want = table(spark, sf_dir, "documents").filter("n_chars > 500").select(F.col("doc_id").alias("name")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"))
    part = lambda a, b, p: a.join(b, "name", "left_anti").select(F.lit(p).alias("problem"), "name")
    return part(want, have, "missing").union(part(have, want, "extra"))


@query(" SELECT source, count(*) AS n, count(*) FILTER (n_chars IS NULL OR n_chars <> length(text)) AS wrong_size, count(*) FILTER (text IS NULL OR length(text) = 0) AS empty, CASE WHEN count(*) FILTER (n_chars IS NULL OR n_chars <> length(text)) > 0 THEN 'refuse' WHEN count(*) FILTER (length(text) < 50) > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM documents GROUP BY source")
def au18_input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU18, AU15: hard checks of the input; refuse beats warn beats pass."""
    wrong = F.col("n_chars").isNull() | (F.col("n_chars") != F.length("text"))
    verdict = F.when(F.count_if(wrong) > 0, "refuse").when(F.count_if(F.length("text") < 50) > 0, "warn").otherwise("pass")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong_size"), F.count_if(F.col("text").isNull() | (F.length("text") == 0)).alias("empty"), verdict.alias("verdict"))


@query(", m AS (SELECT label, max(value) AS top, min(value) AS low, count(*) AS n FROM series GROUP BY label), c AS (SELECT top AS ctop FROM m WHERE label = (SELECT min(label) FROM series)) SELECT label, CASE WHEN top >= 90 THEN 'throttled' WHEN top >= 60 THEN 'warm' ELSE 'ok' END AS state, round(100 - top, 6) AS headroom, round(top - ctop, 6) AS net_of_control FROM m, c", "series")
def au23_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU23: state, headroom and the difference from the control arm."""
    m = views.series(spark, sf_dir).groupBy("label").agg(F.max("value").alias("top"))
    control = m.agg(F.min_by("top", "label").alias("ctop"))
    state = F.when(F.col("top") >= 90, "throttled").when(F.col("top") >= 60, "warm").otherwise("ok")
    return m.crossJoin(F.broadcast(control)).select("label", state.alias("state"), F.round(100 - F.col("top"), 6).alias("headroom"), F.round(F.col("top") - F.col("ctop"), 6).alias("net_of_control"))  # one row


@query(", a AS (SELECT ident, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM series GROUP BY ident), p AS (SELECT max(abs(x.m - y.m) / sqrt(x.s * x.s / x.n + y.s * y.s / y.n)) AS z FROM a x JOIN a y ON x.ident < y.ident) SELECT round(z, 6) AS largest_z, round(max(m) - min(m), 6) AS spread, max(m) - min(m) <= 6 * min(s / sqrt(n)) AS poolable FROM a, p GROUP BY z", "series")
def ag28_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28, ST94: may the arms' chance floors be pooled?"""
    a = views.series(spark, sf_dir).groupBy("ident").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    x, y = a.alias("x"), a.alias("y")
    z = x.join(y, F.col("x.ident") < F.col("y.ident")).agg(F.max(F.expr("abs(x.m - y.m) / sqrt(x.s * x.s / x.n + y.s * y.s / y.n)")).alias("z"))
    s = a.agg((F.max("m") - F.min("m")).alias("spread"), F.min(F.col("s") / F.sqrt("n")).alias("sem"))
    return s.crossJoin(z).select(F.round("z", 6).alias("largest_z"), F.round("spread", 6).alias("spread"), (F.col("spread") <= 6 * F.col("sem")).alias("poolable"))  # one row each


@query(", h AS (SELECT lang, length(text) % 64 AS bin, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT lang, bin, n, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, bin) AS k FROM h) SELECT a.lang AS lang, a.bin AS mode, round(CAST(sum(b.n) AS DOUBLE) / any_value(a.total), 6) AS share FROM t a JOIN t b ON a.lang = b.lang AND abs(a.bin - b.bin) <= 3 WHERE a.k = 1 GROUP BY a.lang, a.bin", "edge")
def ag14_mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14: the fullest bin and the share of bins within three of it."""
    h = table(spark, sf_dir, "documents").groupBy("lang", (F.length("text") % 64).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    h = h.withColumn("mode", F.max_by("bin", F.struct("n", -F.col("bin"))).over(W.partitionBy("lang")))
    return h.groupBy("lang", "mode").agg(F.round(F.sum(F.when(F.abs(F.col("bin") - F.col("mode")) <= 3, F.col("n"))) / F.sum("n"), 6).alias("share"))
