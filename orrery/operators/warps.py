"""Re-timing of pose tracks: a clock that runs unevenly along a clip, and the track read at its times.

Tracks are numbered along their frames; the places to read at fall between samples, which a join on the sample before meets
(its neighbours came along by lag and lead). Ends and lengths stay: the first and last samples are read where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.exprs import clamp, uniform
from orrery.operators.signals import _u
from orrery.plans.registry import query
from orrery.sources import views

#: Strength of the clip's clock, bounds of its speed; sway of the root's clock in frames, its period, and the part of the height that it may move.
AMPLITUDE, SLOW, FAST = 0.3, 0.4, 1.6
SWAY, PERIOD, PART = 1.5, 24.0, 0.05
TRACK = ["clip", "joint"]


def numbered(pose: DataFrame, by: list[str]) -> DataFrame:
    """Tracks with place i (from 0) and length n."""
    return pose.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("frame")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*by)))


def smooth_noise(rows: DataFrame, by: list[str], *seed: Column) -> DataFrame:
    """``w``: normal noise from hashes of the seed and the place, smoothed over five samples."""
    a, b = uniform(F.lit("wa"), *seed, F.col("i")), uniform(F.lit("wb"), *seed, F.col("i"))
    per = W.partitionBy(*by).orderBy("i")
    rows = rows.withColumn("g", F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b))
    near = lambda n: F.coalesce(F.lag("g", n).over(per), F.col("g")) + F.coalesce(F.lead("g", n).over(per), F.col("g"))
    return rows.withColumn("w", 0.4 * F.col("g") + 0.25 * near(1) + 0.05 * near(2)).drop("g")


def clock(rows: DataFrame, by: list[str]) -> DataFrame:
    """WN12, ``t``: the running sum of speeds 1 + AMPLITUDE * w, scaled to run from the first place to the last."""
    per = W.partitionBy(*by)
    speed = clamp(1.0 + AMPLITUDE * (F.col("w") / (F.max(F.abs(F.col("w"))).over(per) + 1e-9)), SLOW, FAST)
    rows = rows.withColumn("speed", speed).withColumn("cum", F.sum("speed").over(per.orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    cum = F.col("cum") - F.first("speed").over(per.orderBy("i"))
    whole = F.max("cum").over(per) - F.min("cum").over(per)
    return rows.withColumn("t", cum / (whole + 1e-9) * (F.col("n") - 1)).drop("speed", "cum")


def read_at(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """rows (by, i, t, values...) with each value read at place t: ``<value>_line`` by a straight line, ``<value>_curve`` by Catmull and Rom's cubic."""
    per = W.partitionBy(*by).orderBy("i")
    beside = {}
    for v in values:
        beside |= {f"{v}0": F.coalesce(F.lag(v).over(per), F.col(v)), f"{v}1": F.col(v), f"{v}2": F.coalesce(F.lead(v).over(per), F.col(v))}
        beside[f"{v}3"] = F.coalesce(F.lead(v, 2).over(per), beside[f"{v}2"])
    held = rows.select(*by, F.col("i").alias("k"), *[c.alias(k) for k, c in beside.items()])
    rows = rows.withColumn("k", F.floor("t").cast("int")).withColumn("f", F.col("t") - F.floor("t")).join(held, [*by, "k"])
    f = F.col("f")
    for v in values:
        a, b, c, d = (F.col(f"{v}{k}") for k in range(4))
        curve = 0.5 * (2 * b + (c - a) * f + (2 * a - 5 * b + 4 * c - d) * f * f + (3 * b - 3 * c + d - a) * f * f * f)
        rows = rows.withColumn(f"{v}_line", (1 - f) * b + f * c).withColumn(f"{v}_curve", curve)
    return rows


_noise = f"sqrt(-2 * ln(1 - {_u.format('wa', 'clip, i')})) * cos(2 * pi() * {_u.format('wb', 'clip, i')})"
_smooth = "0.4 * g + 0.25 * (coalesce(lag(g) OVER w, g) + coalesce(lead(g) OVER w, g)) + 0.05 * (coalesce(lag(g, 2) OVER w, g) + coalesce(lead(g, 2) OVER w, g))"


def _at(v: str) -> str:
    return (
        f"round((1 - f) * {v}1 + f * {v}2, 4) AS {v}_line, "
        f"round(0.5 * (2 * {v}1 + ({v}2 - {v}0) * f + (2 * {v}0 - 5 * {v}1 + 4 * {v}2 - {v}3) * f * f + (3 * {v}1 - 3 * {v}2 + {v}3 - {v}0) * f * f * f), 4) AS {v}_curve"
    )


@query(
    f""", s AS (SELECT *, row_number() OVER (PARTITION BY clip, joint ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip, joint) AS n FROM pose),
g AS (SELECT *, {_noise} AS g FROM s), w AS (SELECT *, {_smooth} AS w FROM g WINDOW w AS (PARTITION BY clip, joint ORDER BY i)),
v AS (SELECT *, greatest({SLOW}, least({FAST}, 1.0 + {AMPLITUDE} * (w / (max(abs(w)) OVER (PARTITION BY clip, joint) + 1e-9)))) AS speed FROM w),
c AS (SELECT *, sum(speed) OVER (PARTITION BY clip, joint ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, first(speed) OVER (PARTITION BY clip, joint ORDER BY i) AS first FROM v),
t AS (SELECT clip, joint, frame, i, (cum - first) / (max(cum) OVER (PARTITION BY clip, joint) - min(cum) OVER (PARTITION BY clip, joint) + 1e-9) * (n - 1) AS t FROM c),
h AS (SELECT clip, joint, i AS k, x AS x1, coalesce(lag(x) OVER o, x) AS x0, coalesce(lead(x) OVER o, x) AS x2, coalesce(lead(x, 2) OVER o, lead(x) OVER o, x) AS x3,
             y AS y1, coalesce(lag(y) OVER o, y) AS y0, coalesce(lead(y) OVER o, y) AS y2, coalesce(lead(y, 2) OVER o, lead(y) OVER o, y) AS y3 FROM s WINDOW o AS (PARTITION BY clip, joint ORDER BY i)),
f AS (SELECT *, t - floor(t) AS f, CAST(floor(t) AS BIGINT) AS k FROM t)
SELECT f.clip, f.joint, f.frame, round(t, 6) AS t, {_at("x")}, {_at("y")} FROM f JOIN h ON h.clip = f.clip AND h.joint = f.joint AND h.k = f.k""",
    "pose",
)
def po06_cadence_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO06, WN12, TS05: every joint's track read along one uneven clock of its clip, by straight lines and by cubics.

    Tracks of one sample stay. The clock follows from clip and place, never from data.
    """
    s = clock(smooth_noise(numbered(views.pose(spark, sf_dir), TRACK), TRACK, F.col("clip")), TRACK)
    r = read_at(s, TRACK, ["x", "y"])
    return r.select("clip", "joint", "frame", F.round("t", 6).alias("t"), *[F.round(c, 4).alias(c) for c in ("x_line", "x_curve", "y_line", "y_curve")])


@query(
    f""", r AS (SELECT clip, frame, avg(x) AS x, avg(y) AS y FROM pose WHERE joint IN (11, 12) GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM r),
t AS (SELECT *, greatest(0.0, least(n - 1.0, i + {SWAY} * sin(2 * pi() * i / {PERIOD} + 2 * pi() * {_u.format('sway', 'clip, 0')}))) AS t FROM s),
h AS (SELECT clip, i AS k, x AS x1, coalesce(lead(x) OVER o, x) AS x2, y AS y1, coalesce(lead(y) OVER o, y) AS y2 FROM s WINDOW o AS (PARTITION BY clip ORDER BY i)),
d AS (SELECT t.clip, frame, (1 - (t - floor(t))) * x1 + (t - floor(t)) * x2 - x AS dx, (1 - (t - floor(t))) * y1 + (t - floor(t)) * y2 - y AS dy FROM t JOIN h ON h.clip = t.clip AND h.k = CAST(floor(t) AS BIGINT)),
tall AS (SELECT clip, median(h) AS h FROM (SELECT clip, frame, max(y) - min(y) AS h FROM pose GROUP BY ALL HAVING count(*) >= 2) GROUP BY clip),
m AS (SELECT d.clip, max(greatest(abs(dx), abs(dy))) AS worst, any_value(greatest({PART} * coalesce(h, 1), 1e-6)) AS cap FROM d LEFT JOIN tall ON tall.clip = d.clip GROUP BY d.clip)
SELECT p.clip, p.joint, p.frame, round(p.x + coalesce(dx * CASE WHEN worst > cap THEN cap / worst ELSE 1 END, 0), 4) AS x, round(p.y + coalesce(dy * CASE WHEN worst > cap THEN cap / worst ELSE 1 END, 0), 4) AS y
FROM pose p LEFT JOIN d ON d.clip = p.clip AND d.frame = p.frame LEFT JOIN m ON m.clip = p.clip""",
    "pose",
)
def po09_root_speed_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO09: the root is read along a swaying clock, and the whole figure moves with it, by PART of its median height at most.

    Frames without a root stay as they are; of a clip whose height is unknown the height counts as 1.
    """
    pose = views.pose(spark, sf_dir)
    root = numbered(pose.filter("joint IN (11, 12)").groupBy("clip", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), ["clip"])
    phase = 2 * F.pi() * uniform(F.lit("sway"), F.col("clip"), F.lit(0))
    t = F.greatest(F.lit(0.0), F.least(F.col("n") - 1.0, F.col("i") + SWAY * F.sin(2 * F.pi() * F.col("i") / PERIOD + phase)))
    moved = read_at(root.withColumn("t", t), ["clip"], ["x", "y"]).select("clip", "frame", (F.col("x_line") - F.col("x")).alias("dx"), (F.col("y_line") - F.col("y")).alias("dy"))
    height = pose.groupBy("clip", "frame").agg((F.max("y") - F.min("y")).alias("h"), F.count("*").alias("n")).filter("n >= 2").groupBy("clip").agg(F.percentile("h", 0.5).alias("h"))
    worst = moved.groupBy("clip").agg(F.max(F.greatest(F.abs(F.col("dx")), F.abs(F.col("dy")))).alias("worst")).join(height, "clip", "left")
    cap = F.greatest(PART * F.coalesce("h", F.lit(1.0)), F.lit(1e-6))
    scale = worst.select("clip", F.when(F.col("worst") > cap, cap / F.col("worst")).otherwise(1.0).alias("scale"))
    out = pose.join(moved, ["clip", "frame"], "left").join(scale, "clip", "left")
    place = lambda c: F.round(F.col(c) + F.coalesce(F.col(f"d{c}") * F.col("scale"), F.lit(0.0)), 4).alias(c)
    return out.select("clip", "joint", "frame", place("x"), place("y"))
