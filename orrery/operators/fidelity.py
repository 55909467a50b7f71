"""How like two sets of frames are: structural similarity from box sums, and the Frechet distance from mergeable moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.sources import views

#: Side of a canvas, of the window of local moments; orders that share a frame; the constants of the measure for values to 255.
SIDE, BOX, ORDERS = 16, 7, 256
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
_edge = BOX // 2

_frames = f""", v AS (SELECT l_orderkey // {ORDERS} AS frame, CAST(l_partkey % {SIDE} AS INTEGER) AS y, CAST((l_suppkey + l_linenumber * 5) % {SIDE} AS INTEGER) AS x, CAST(sum(l_quantity * 7) % 256 AS INTEGER) AS a FROM lineitem GROUP BY ALL),
g AS (SELECT frame, y, x FROM (SELECT DISTINCT frame FROM v), generate_series(0, {SIDE - 1}) t(y), generate_series(0, {SIDE - 1}) u(x)),
c AS (SELECT frame, g.y, g.x, CAST(coalesce(a, 0) AS DOUBLE) AS a, CASE WHEN frame % 8 = 0 THEN CAST(coalesce(a, 0) AS DOUBLE) ELSE floor(coalesce(a, 0) / 32.0) * 32 END AS b FROM g LEFT JOIN v USING (frame, y, x))"""


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, a, b): grey values of whole canvases, and those of a coarser arm that leaves every eighth frame as it is."""
    line = views.table(spark, sf_dir, "lineitem").groupBy(
        F.expr(f"l_orderkey div {ORDERS}").alias("frame"), F.expr(f"cast(l_partkey % {SIDE} AS int)").alias("y"), F.expr(f"cast((l_suppkey + l_linenumber * 5) % {SIDE} AS int)").alias("x")
    )
    v = line.agg(F.expr("cast(sum(l_quantity * 7) % 256 AS int)").alias("a"))
    places = F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))
    g = v.select("frame").distinct().withColumn("y", places).withColumn("x", places)
    a = F.coalesce("a", F.lit(0)).cast("double")
    coarse = F.when(F.col("frame") % 8 == 0, a).otherwise(F.floor(a / 32) * 32).cast("double")
    return g.join(v, ["frame", "y", "x"], "left").select("frame", "y", "x", a.alias("a"), coarse.alias("b"))


def box_sums(pixels: DataFrame, values: dict[str, Column], by: list[str]) -> DataFrame:
    """Sums of ``values`` over the BOX x BOX pixels around each, of whole canvases: first down each column, then along each row."""
    around = lambda part, order: W.partitionBy(*by, part).orderBy(order).rowsBetween(-_edge, _edge)
    down = pixels.select(*by, "y", "x", *[F.sum(v).over(around("x", "y")).alias(k) for k, v in values.items()])
    return down.select(*by, "y", "x", *[F.sum(k).over(around("y", "x")).alias(k) for k in values])


def structural_similarity(pixels: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """(by, ssim): mean over the pixels whose box lies within the canvas; moments by sample covariance, as is usual.

    pixels: (by, y, x, a, b), a row for each pixel of each canvas; canvases under BOX pixels a side give none.
    """
    a, b, n = F.col("a"), F.col("b"), BOX * BOX
    m = box_sums(pixels, {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}, by)
    m = m.filter(F.col("y").between(_edge, height - 1 - _edge) & F.col("x").between(_edge, width - 1 - _edge))
    ua, ub = F.col("a") / n, F.col("b") / n
    spread = lambda s, u, v: (F.col(s) / n - u * v) * (n / (n - 1))
    top = (2 * ua * ub + C1) * (2 * spread("ab", ua, ub) + C2)
    under = (ua * ua + ub * ub + C1) * (spread("aa", ua, ua) + spread("bb", ub, ub) + C2)
    return m.groupBy(*by).agg(F.avg(top / under).alias("ssim"))


def _sums(part: str, order: str, source: str) -> str:
    sums = ", ".join(f"sum({k}) OVER w AS {k}" for k in ("a", "b", "aa", "bb", "ab"))
    return f"SELECT frame, y, x, {sums} FROM {source} WINDOW w AS (PARTITION BY frame, {part} ORDER BY {order} ROWS BETWEEN {_edge} PRECEDING AND {_edge} FOLLOWING)"


@query(
    _frames + f""", e AS (SELECT frame, y, x, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM c), d AS ({_sums("x", "y", "e")}), r AS ({_sums("y", "x", "d")}),
u AS (SELECT frame, a / 49 AS ua, b / 49 AS ub, (aa / 49 - a / 49 * a / 49) * 49.0 / 48 AS va, (bb / 49 - b / 49 * b / 49) * 49.0 / 48 AS vb, (ab / 49 - a / 49 * b / 49) * 49.0 / 48 AS vab
      FROM r WHERE y BETWEEN {_edge} AND {SIDE - 1 - _edge} AND x BETWEEN {_edge} AND {SIDE - 1 - _edge}),
s AS (SELECT frame, avg((2 * ua * ub + {C1}) * (2 * vab + {C2}) / ((ua * ua + ub * ub + {C1}) * (va + vb + {C2}))) AS ssim FROM u GROUP BY frame),
q AS (SELECT frame, avg((a - b) * (a - b)) AS mse FROM c GROUP BY frame)
SELECT count(*) AS frames, count(*) FILTER (mse = 0) AS identical, round(avg(ssim), 6) AS mean_ssim, round(stddev_pop(ssim), 6) AS sd_ssim,
       round(avg(CASE WHEN mse > 0 THEN 10 * log10(65025.0 / mse) END), 5) AS mean_psnr, round(stddev_pop(CASE WHEN mse > 0 THEN 10 * log10(65025.0 / mse) END), 5) AS sd_psnr FROM s JOIN q USING (frame)""",
    "box",
)
def ag30_structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG30: structural similarity and signal-to-noise ratio of two arms, mean and deviation over frames; identical frames counted apart."""
    c = canvas(spark, sf_dir)
    mse = c.groupBy("frame").agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    each = structural_similarity(c, ["frame"], SIDE, SIDE).join(mse, "frame").withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(65025.0 / F.col("mse"))))
    figures = [F.round(f(k), n).alias(f"{name}_{k}") for k, n in (("ssim", 6), ("psnr", 5)) for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return each.agg(F.count("*").alias("frames"), F.count_if(F.col("mse") == 0).alias("identical"), *figures)


def moments(vectors: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """(rows, mean, covariance) of each arm. vectors: (arm string, v array<double>), all of one length d; null vectors are left out.

    A task adds up what it reads, in d x d numbers an arm, taken from one common vector so that sums of squares keep their
    digits; the shuffle adds the tasks' numbers cell by cell, and d x d of them an arm reach the driver.
    """
    vectors = vectors.filter("v IS NOT NULL")
    some = vectors.select("v").first()
    if some is None:
        return {}
    origin = np.array(some.v, float)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for arm, part in batch.groupby("arm"):
                x = np.array(part["v"].tolist(), float) - origin
                x = np.hstack([np.ones((len(x), 1)), x])  # the first row of the product has the count and the sums
                total[arm] = total.get(arm, 0) + x.T @ x
        for arm, t in total.items():
            i, j = np.triu_indices(len(t))
            yield pd.DataFrame({"arm": arm, "i": i.astype(np.int32), "j": j.astype(np.int32), "s": t[i, j]})

    cells = vectors.mapInPandas(emit, "arm string, i int, j int, s double").groupBy("arm", "i", "j").agg(F.sum("s").alias("s"))
    out, d = {}, len(origin) + 1
    square: dict[str, np.ndarray] = {}
    for r in cells.toLocalIterator():
        t = square.setdefault(r.arm, np.zeros((d, d)))
        t[r.i, r.j] = t[r.j, r.i] = r.s
    for arm, t in square.items():
        n, mean = int(round(t[0, 0])), t[0, 1:] / t[0, 0]
        out[arm] = n, origin + mean, (t[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1)
    return out


def root_trace(a: np.ndarray, b: np.ndarray) -> float:
    """The trace of the root of a b, for symmetric matrices without negative eigenvalues (rounding aside)."""
    w, v = np.linalg.eigh(a)
    half = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    return float(np.sqrt(np.maximum(np.linalg.eigvalsh(half @ b @ half), 0)).sum())


@query()
def ag29_frechet_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29: the Frechet distance between normal distributions fitted to the vectors of two arms (collections): one row.

    Null where an arm is empty. Held against numpy on the whole table in the tests.
    """
    item = views.item(spark, sf_dir).select(F.col("coll").cast("string").alias("arm"), "v")
    m = moments(item)
    (n, mu, s), (k, nu, t) = (m.get(arm, (0, np.zeros(1), np.zeros((1, 1)))) for arm in ("0", "1"))
    value = float((mu - nu) @ (mu - nu) + np.trace(s) + np.trace(t) - 2 * root_trace(s, t)) if n and k else None
    # one row of figures; the table behind it was read above
    return views.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors")).select("vectors", F.lit(n).cast("long").alias("n_a"), F.lit(k).cast("long").alias("n_b"), F.round(F.lit(value).cast("double"), 6).alias("frechet"))
