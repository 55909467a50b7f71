"""Signals of face and pose channels: filters with state, resampling, descriptors, noise, idle motion. A day of a label is a clip."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.clips import walk
from orrery.functions.exprs import uniform
from orrery.plans.registry import query
from orrery.sources import views

#: Variances of the process and of a measurement; the follower's share of a step and its greatest step.
PROCESS, NOISE, FOLLOW, SLEW = 4.0, 100.0, 0.4, 8.0

_clip = """, z AS (SELECT label, us // 86400000000 AS day, ord, value AS z, row_number() OVER (PARTITION BY label, us // 86400000000 ORDER BY us, ord) AS i, count(*) OVER (PARTITION BY label, us // 86400000000) AS n FROM series)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, day, ord, z, i, n): samples of a label's day in order."""
    per = W.partitionBy("label", "day")
    s = views.series(spark, sf_dir).select("label", F.expr("us div 86400000000 AS day"), "us", "ord", F.col("value").alias("z"))
    return s.select("label", "day", "ord", "z", F.row_number().over(per.orderBy("us", "ord")).alias("i"), F.count("*").over(per).alias("n"))


def smoothed(z: np.ndarray, process: float = PROCESS, noise: float = NOISE) -> np.ndarray:
    """A random walk seen with noise: filtered forward, then smoothed backward."""
    x, p = np.empty(len(z)), np.empty(len(z))
    for i, v in enumerate(z):
        ahead = p[i - 1] + process if i else noise
        gain = ahead / (ahead + noise) if i else 1.0
        x[i] = x[i - 1] + gain * (v - x[i - 1]) if i else v
        p[i] = (1 - gain) * ahead if i else noise
    out = x.copy()
    for i in range(len(z) - 2, -1, -1):
        out[i] = x[i] + p[i] / (p[i] + process) * (out[i + 1] - x[i])
    return out


def followed(z: np.ndarray, share: float = FOLLOW, most: float = SLEW) -> np.ndarray:
    """A follower that makes up a share of what is lacking, never more than its greatest step."""
    out = np.array(z, float)
    for i in range(1, len(z)):
        out[i] = out[i - 1] + min(most, max(-most, share * (z[i] - out[i - 1])))
    return out


def _both() -> Callable[[list[tuple]], list[tuple]]:
    """Called with the rows (label, day, ord, z, i, n) of a whole clip."""

    def run(rows: list[tuple]) -> list[tuple]:
        z = np.array([r[3] for r in rows])
        return list(zip([r[2] for r in rows], smoothed(z).round(6).tolist(), followed(z).round(6).tolist(), strict=True))

    return run


@query(_clip + f""", f(label, day, i, x, p, y) AS (
  SELECT label, day, i, z, {NOISE}::DOUBLE, z FROM z WHERE i = 1
  UNION ALL
  SELECT z.label, z.day, z.i, f.x + (f.p + {PROCESS}) / (f.p + {PROCESS} + {NOISE}) * (z.z - f.x), (1 - (f.p + {PROCESS}) / (f.p + {PROCESS} + {NOISE})) * (f.p + {PROCESS}),
         f.y + least({SLEW}, greatest(-{SLEW}, {FOLLOW} * (z.z - f.y)))
  FROM f JOIN z ON z.label = f.label AND z.day = f.day AND z.i = f.i + 1),
b(label, day, i, s) AS (
  SELECT f.label, f.day, f.i, f.x FROM f JOIN z ON z.label = f.label AND z.day = f.day AND z.i = f.i AND z.i = z.n
  UNION ALL
  SELECT f.label, f.day, f.i, f.x + f.p / (f.p + {PROCESS}) * (b.s - f.x) FROM b JOIN f ON f.label = b.label AND f.day = b.day AND f.i = b.i - 1)
SELECT z.ord, round(b.s, 6) AS smooth, round(f.y, 6) AS follow FROM z JOIN f ON f.label = z.label AND f.day = z.day AND f.i = z.i JOIN b ON b.label = z.label AND b.day = z.day AND b.i = z.i""", "series")
def ts02_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS02, TS03: a filter with its backward smoother, and a follower with a greatest step. Each sample needs the one
    before, and the backward pass a whole clip (a label's day)."""
    return walk(clips(spark, sf_dir), ["label", "day"], ["i"], [], _both, "ord long, smooth double, follow double")


@query(_clip + """, d AS (SELECT *, z - lag(z) OVER (PARTITION BY label, day ORDER BY i) AS d FROM z),
g AS (SELECT label, day, avg(z) AS m, var_pop(z) AS v, avg(d * d) / 2 AS e FROM d GROUP BY label, day)
SELECT ord, round(CASE WHEN v > 0 THEN greatest(0, 1 - coalesce(e, 0) / v) ELSE 0 END, 6) AS gain, coalesce(v > 0 AND 1 - coalesce(e, 0) / v > 0.05, false) AS trusted,
 round(least(100, greatest(0, m + CASE WHEN v > 0 THEN greatest(0, 1 - coalesce(e, 0) / v) ELSE 0 END * (z - m))), 6) AS filtered FROM z JOIN g ON g.label = z.label AND g.day = z.day""", "series")
def ts04_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS04: noise from differences, a gain towards the mean from both variances, a flag of trust, and bounds."""
    d = clips(spark, sf_dir).withColumn("d", F.col("z") - F.lag("z").over(W.partitionBy("label", "day").orderBy("i")))
    g = d.groupBy("label", "day").agg(F.avg("z").alias("m"), F.var_pop("z").alias("v"), (F.avg(F.col("d") * F.col("d")) / 2).alias("e"))
    g = g.withColumn("gain", F.expr("CASE WHEN v > 0 THEN greatest(0D, 1 - coalesce(e, 0) / v) ELSE 0D END")).withColumn("trusted", F.expr("coalesce(v > 0 AND 1 - coalesce(e, 0) / v > 0.05D, false)"))
    out = d.join(g, ["label", "day"])
    return out.select("ord", F.round("gain", 6).alias("gain"), "trusted", F.expr("round(least(100D, greatest(0D, m + gain * (z - m))), 6) AS filtered"))


@query(_clip + """, p AS (SELECT DISTINCT label, day, n, k, k * (n - 1) / 15.0 AS pos FROM z, generate_series(0, 15) t(k))
SELECT p.label, p.day, CAST(p.k AS INTEGER) AS k, round(a.z + (pos - floor(pos)) * (coalesce(b.z, a.z) - a.z), 6) AS value
FROM p JOIN z a ON a.label = p.label AND a.day = p.day AND a.i = CAST(floor(pos) AS BIGINT) + 1 LEFT JOIN z b ON b.label = p.label AND b.day = p.day AND b.i = a.i + 1""", "series")
def ts05_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS05: sixteen values at even places along each clip, by straight lines between samples."""
    z = clips(spark, sf_dir).withColumn("next", F.lead("z").over(W.partitionBy("label", "day").orderBy("i")))
    p = z.filter("i = 1").select("label", "day", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).withColumn("at", F.expr("k * (n - 1) / 15.0D"))
    p = p.withColumn("i", F.expr("cast(floor(at) + 1 AS int)"))
    out = p.drop("n").join(z, ["label", "day", "i"])
    return out.select("label", "day", "k", F.expr("round(z + (at - floor(at)) * (coalesce(next, z) - z), 6) AS value"))


@query(_clip + """, c AS (SELECT label, day, i, z - avg(z) OVER (PARTITION BY label, day) AS c FROM z),
l AS (SELECT a.label, a.day, lag, sum(a.c * b.c) AS s FROM c a, generate_series(1, 6) t(lag) JOIN c b ON b.label = a.label AND b.day = a.day AND b.i = a.i + lag GROUP BY a.label, a.day, lag),
r AS (SELECT *, row_number() OVER (PARTITION BY label, day ORDER BY round(s, 6) DESC, lag) AS k FROM l) SELECT r.label, r.day, CAST(lag AS INTEGER) AS lag, round(s / q, 6) AS likeness FROM r JOIN (SELECT label, day, sum(c * c) AS q FROM c GROUP BY label, day) e ON e.label = r.label AND e.day = r.day WHERE k = 1 AND round(q, 6) > 0""", "series")
def ts07_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS07: the shift of one to six samples at which a clip is most like itself."""
    c = clips(spark, sf_dir).select("label", "day", "i", (F.col("z") - F.avg("z").over(W.partitionBy("label", "day"))).alias("c"))
    per = W.partitionBy("label", "day").orderBy("i")
    wide = c.select("label", "day", (F.col("c") * F.col("c")).alias("q"), *[(F.col("c") * F.lead("c", k).over(per)).alias(f"p{k}") for k in range(1, 7)])
    sums = wide.groupBy("label", "day").agg(F.sum("q").alias("q"), *[F.sum(f"p{k}").alias(f"s{k}") for k in range(1, 7)])
    best = F.array_max(F.filter(F.array(*[F.struct(F.round(f"s{k}", 6).alias("r"), F.lit(-k).alias("k"), F.col(f"s{k}").alias("s")) for k in range(1, 7)]), lambda x: x["s"].isNotNull()))
    return sums.select("label", "day", "q", best.alias("b")).filter("b is not null and round(q, 6) > 0").select("label", "day", (-F.col("b.k")).alias("lag"), F.round(F.col("b.s") / F.col("q"), 6).alias("likeness"))


_desc = ["avg(x2 - x1) AS width", "avg(y2 - y1) AS height", "avg((x2 - x1) / (y2 - y1)) AS aspect", "stddev_samp((x1 + x2) / 2) AS sway", "stddev_samp((y1 + y2) / 2) AS bob", "min(x1) AS least", "max(x2) AS most", "avg(score) AS score"]
_named = [f"round({d.split(' AS ')[0]}, 6) AS {d.split(' AS ')[1]}" for d in _desc]


@query(f" SELECT frame % 97 AS clip, {', '.join(_named)}, round(quantile_cont(x2 - x1, 0.5), 6) AS w50, round(quantile_cont(x2 - x1, 0.9), 6) AS w90, count(*) AS n FROM box GROUP BY 1", "box")
def ts09_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS08, TS09: a clip's descriptor: sizes, ratios, spread of the centre, medians and ninetieth percentiles."""
    rows = views.box(spark, sf_dir).groupBy(F.expr("frame % 97 AS clip"))
    return rows.agg(*[F.expr(e) for e in _named], F.expr("round(percentile(x2 - x1, 0.5), 6) AS w50"), F.expr("round(percentile(x2 - x1, 0.9), 6) AS w90"), F.count("*").alias("n"))


@query(_clip + """ SELECT a.ord, b.z AS held FROM z a JOIN z b ON b.label = a.label AND b.day = a.day AND b.i = (a.i - 1) // 4 * 4 + 1""", "series")
def ts11_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS11: every fourth sample, held until the next."""
    z = clips(spark, sf_dir).withColumn("part", F.expr("(i - 1) div 4"))
    return z.select("ord", F.first("z").over(W.partitionBy("label", "day", "part").orderBy("i")).alias("held"))


@query(""", g AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM series), l AS (SELECT label, avg(value) AS m, stddev_pop(value) AS s FROM series GROUP BY label)
SELECT ord, round(CASE WHEN l.s > 0 THEN (value - l.m) / l.s * g.s + g.m ELSE g.m END, 6) AS value FROM series JOIN l ON l.label = series.label, g""", "series")
def ts12_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS12: each label brought to the mean and deviation of all."""
    s = views.series(spark, sf_dir)
    g = s.agg(F.avg("value").alias("gm"), F.stddev_pop("value").alias("gs"))  # one row
    l = s.groupBy("label").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    out = s.join(l, "label").crossJoin(F.broadcast(g))
    return out.select("ord", F.expr("round(CASE WHEN s > 0 THEN (value - m) / s * gs + gm ELSE gm END, 6) AS value"))


_u = "CAST(('0x' || substr(md5(concat_ws('|', '{0}', {1})), 1, 8)) AS BIGINT) / 4294967296.0"
_noise = f""", k AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT clip, frame FROM pose)),
u AS (SELECT clip, i, sqrt(-2 * ln(1 - {_u.format('a', 'clip, i')})) * cos(2 * pi() * {_u.format('b', 'clip, i')}) AS g FROM k),
s AS (SELECT clip, i, 0.4 * g + 0.25 * (coalesce(lag(g) OVER w, g) + coalesce(lead(g) OVER w, g)) + 0.05 * (coalesce(lag(g, 2) OVER w, g) + coalesce(lead(g, 2) OVER w, g)) AS s FROM u WINDOW w AS (PARTITION BY clip ORDER BY i))
SELECT clip, i, round((s - avg(s) OVER (PARTITION BY clip)) / nullif(stddev_pop(s) OVER (PARTITION BY clip), 0), 6) AS noise, round(3 * sin(2 * pi() * i / 48) + {_u.format('idle', 'clip, i')}, 6) AS idle FROM s"""


@query(_noise, "pose")
def rnd04_band_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND04, DP05: smooth noise of unit deviation, and idle motion, for every frame of every clip; both follow from clip and place, never from poses.

    Null where a clip's noise does not vary (one frame).
    """
    frames = views.pose(spark, sf_dir).select("clip", "frame").distinct()
    k = frames.select("clip", (F.row_number().over(W.partitionBy("clip").orderBy("frame")) - 1).cast("long").alias("i"))
    a, b = uniform(F.lit("a"), F.col("clip"), F.col("i")), uniform(F.lit("b"), F.col("clip"), F.col("i"))
    u = k.withColumn("g", F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b))
    per = W.partitionBy("clip").orderBy("i")
    near = lambda n: F.coalesce(F.lag("g", n).over(per), F.col("g")) + F.coalesce(F.lead("g", n).over(per), F.col("g"))
    s = u.withColumn("s", 0.4 * F.col("g") + 0.25 * near(1) + 0.05 * near(2))
    whole = W.partitionBy("clip")
    noise = (F.col("s") - F.avg("s").over(whole)) / F.nullif(F.stddev_pop("s").over(whole), F.lit(0.0))
    return s.select("clip", "i", F.round(noise, 6).alias("noise"), F.round(3 * F.sin(2 * F.pi() * F.col("i") / 48) + uniform(F.lit("idle"), F.col("clip"), F.col("i")), 6).alias("idle"))


@query(_clip + """ SELECT ord, round(CASE WHEN z.i % 5 <> 0 THEN z.z ELSE 50 + 3 * sin(2 * pi() * z.i / 48) END, 6) AS drive, z.i % 5 = 0 AS idle FROM z""", "series")
def ts16_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS16: what is trusted drives; idle motion fills the rest."""
    trusted = F.when(F.expr("i % 5 <> 0"), F.col("z"))
    return clips(spark, sf_dir).select("ord", F.round(F.coalesce(trusted, 50 + 3 * F.sin(2 * F.pi() * F.col("i") / 48)), 6).alias("drive"), trusted.isNull().alias("idle"))
