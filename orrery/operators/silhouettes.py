"""Silhouettes brought to one size: cropped, scaled to a height, and centred on the upper body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.masks import of_kind, tasks_for
from orrery.plans.registry import query
from orrery.sources import views

#: Side of the result and rows that a mask must span.
SIZE, LEAST = 64, 8


def normalised(mask: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """TS13: (frame, y, x, value) of masks (frame, y, x), each scaled to ``size`` rows (bilinear, 0 to 255) about its upper half's mean column.

    Every source pixel is dealt to the places that read it, so no canvas is put together. Empty cells have no row; masks of under
    ``least`` rows have none at all; repeated pixels count once, null places are left out; columns beyond the square are cut.
    """
    mask = mask.select("frame", "y", "x").filter("frame is not null and y is not null and x is not null")
    mask = mask.repartition(tasks_for(mask), "frame").distinct()
    box = mask.groupBy("frame").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    box = box.selectExpr("frame", "y0", "x0", "y1 - y0 + 1 AS h", "x1 - x0 + 1 AS w").filter(F.col("h") >= least)
    box = box.withColumn("tw", F.greatest(F.lit(1), F.bround(F.col("w") * size / F.col("h")).cast("int"))).withColumn("th", F.lit(size))
    rows = mask.join(box, "frame")
    for at, n, t, first in (("y", "h", "th", "y0"), ("x", "w", "tw", "x0")):
        # places whose reading lies within one sample of this pixel; those at the border read the border itself
        rows = rows.withColumn("p", F.col(at) - F.col(first))
        low = F.when(F.col("p") == 0, 0).otherwise(F.floor((F.col("p") - 0.5) * F.col(t) / F.col(n) - 0.5))
        high = F.when(F.col("p") == F.col(n) - 1, F.col(t) - 1).otherwise(F.ceil((F.col("p") + 1.5) * F.col(t) / F.col(n) - 0.5))
        rows = rows.withColumn(f"t{at}", F.explode(F.sequence(F.greatest(F.lit(0), low.cast("int")), F.least(F.col(t) - 1, high.cast("int")))))
        read = F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, (F.col(f"t{at}") + 0.5) * F.col(n) / F.col(t) - 0.5))
        rows = rows.withColumn(f"w{at}", 1 - F.abs(read - F.col("p"))).filter(F.col(f"w{at}") > 0)
    cell = rows.groupBy("frame", "ty", "tx").agg(F.round(F.sum(F.col("wy") * F.col("wx")), 9).alias("share"), F.first("tw").alias("tw"))
    cell = cell.withColumn("value", F.round(F.col("share") * 255).cast("int")).filter("value > 0")
    centre = cell.groupBy("frame").agg(F.coalesce(F.bround(F.avg(F.when(F.col("ty") < size // 2, F.col("tx")))).cast("int"), F.expr("first(tw) div 2")).alias("cx"))
    out = cell.join(centre, "frame").select("frame", F.col("ty").cast("int").alias("y"), (F.col("tx") - F.col("cx") + size // 2).cast("int").alias("x"), "value")
    return out.filter(F.col("x").between(0, size - 1))


@query(
    f""", raw AS (SELECT frame, y, x FROM px WHERE kind = 'raw'), b AS (SELECT frame, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM raw GROUP BY frame HAVING max(y) - min(y) + 1 >= {LEAST}),
c AS (SELECT *, greatest(1, CAST(round_even(w * {SIZE}.0 / h, 0) AS INTEGER)) AS tw FROM b),
g AS (SELECT c.*, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, greatest(0.0, least(h - 1.0, (ty + 0.5) * h / {SIZE}e0 - 0.5)) AS sy, greatest(0.0, least(w - 1.0, (tx + 0.5e0) * w / tw - 0.5)) AS sx FROM c, range({SIZE}) a(ty), range(0, 1000) d(tx) WHERE tx < tw),
v AS (SELECT g.frame, ty, tx, tw, CAST(round(round(sum((1 - abs(sy - (y - y0))) * (1 - abs(sx - (x - x0)))), 9) * 255) AS INTEGER) AS value FROM g JOIN raw ON raw.frame = g.frame AND abs(sy - (y - y0)) < 1 AND abs(sx - (x - x0)) < 1 GROUP BY ALL HAVING value > 0),
m AS (SELECT frame, coalesce(CAST(round_even(avg(tx) FILTER (ty < {SIZE // 2}), 0) AS INTEGER), any_value(tw) // 2) AS cx FROM v GROUP BY frame)
SELECT frame, ty AS y, CAST(tx - cx + {SIZE // 2} AS INTEGER) AS x, value FROM v JOIN m USING (frame) WHERE tx - cx + {SIZE // 2} BETWEEN 0 AND {SIZE - 1}""",
    "px",
)
def ts13_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS13: every mask cropped, scaled to 64 rows and centred on its upper half."""
    return normalised(of_kind(views.px(spark, sf_dir), "raw"))
