"""Windows and time series over samples by label (in time order, then by sample number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.sources import views

_w = "PARTITION BY label ORDER BY us, ord"


def order() -> WindowSpec:
    return W.partitionBy("label").orderBy("us", "ord")


def rounded(name: str, to: str | None = None):
    return F.round(name, 6).alias(to or name)


@query(f", s AS (SELECT *, lag(us) OVER ({_w}) AS u0, lag(value) OVER ({_w}) AS v0 FROM series) SELECT label, round(sum(0.5 * (value + v0) * (us - u0) / 1e6), 4) AS energy, count(*) AS n FROM s GROUP BY label HAVING count(*) >= 2", "series")
def ag17_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: integral of a sampled value by trapezoids, for labels of two samples or more."""
    s = views.series(spark, sf_dir).withColumn("u0", F.lag("us").over(order())).withColumn("v0", F.lag("value").over(order()))
    part = 0.5 * (F.col("value") + F.col("v0")) * (F.col("us") - F.col("u0")) / 1e6
    return s.groupBy("label").agg(F.round(F.sum(part), 4).alias("energy"), F.count("*").alias("n")).filter("n >= 2")


@query(" SELECT label, arg_min(value, (us, ord)) AS first_value, arg_max(value, (us, ord)) AS last_value, max(value) AS top, round(max(value) - min(value), 6) AS span FROM series GROUP BY label", "series")
def ag16_first_last_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16, AG01: first, last, largest and spread of each label."""
    at = F.struct("us", "ord")
    return views.series(spark, sf_dir).groupBy("label").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"), F.max("value").alias("top"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


@query(" SELECT ident, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM series GROUP BY ident", "series")
def ag02_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG02-AG05: exact interpolated percentiles, both deviations and the standard error."""
    p = lambda q, n: F.round(F.percentile("value", F.lit(q)), 6).alias(n)
    return views.series(spark, sf_dir).groupBy("ident").agg(
        p(0.05, "p05"), p(0.5, "p50"), p(0.9, "p90"), p(0.99, "p99"), F.round(F.stddev_pop("value"), 6).alias("sd_pop"),
        F.round(F.stddev_samp("value"), 6).alias("sd_samp"), F.round(F.stddev_samp("value") / F.sqrt(F.count("value")), 6).alias("sem"),
    )


@query(f" SELECT ord, round(avg(value) OVER ({_w} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM series", "series")
def wn02_centred_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN02: moving mean over seven samples; fewer at the edges."""
    return views.series(spark, sf_dir).select("ord", F.round(F.avg("value").over(order().rowsBetween(-3, 3)), 6).alias("smooth"))


@query(f", s AS (SELECT *, CASE WHEN value > 50 THEN 1 ELSE 0 END AS b FROM series) SELECT ord, 2 * sum(b) OVER ({_w} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= count(*) OVER ({_w} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS vote FROM s", "series")
def wn04_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN04: majority within two samples on either side; a tie counts as yes."""
    w = order().rowsBetween(-2, 2)
    return views.series(spark, sf_dir).select("ord", (2 * F.sum((F.col("value") > 50).cast("int")).over(w) >= F.count("*").over(w)).alias("vote"))


@query(f", s AS (SELECT *, value - lag(value) OVER ({_w}) AS speed FROM series) SELECT ord, round(speed, 6) AS speed, round(speed - lag(speed) OVER ({_w}), 6) AS acceleration FROM s", "series")
def wn05_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN05: first and second differences."""
    s = views.series(spark, sf_dir).withColumn("d", F.col("value") - F.lag("value").over(order()))
    return s.select("ord", rounded("d", "speed"), F.round(F.col("d") - F.lag("d").over(order()), 6).alias("acceleration"))


@query(f", s AS (SELECT *, CASE WHEN row_number() OVER ({_w}) = 1 OR ident IS DISTINCT FROM lag(ident) OVER ({_w}) THEN 1 ELSE 0 END AS starts FROM series), r AS (SELECT *, sum(starts) OVER ({_w}) AS run FROM s) SELECT label, CAST(run AS BIGINT) AS run, any_value(ident) AS ident, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM r GROUP BY label, run", "series")
def wn07_identity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN07: maximal runs of one identity; a missing identity is an identity of its own."""
    s = views.series(spark, sf_dir)
    starts = (F.row_number().over(order()) == 1) | ~F.col("ident").eqNullSafe(F.lag("ident").over(order()))
    r = s.withColumn("starts", starts.cast("long")).withColumn("run", F.sum("starts").over(order()))
    return r.groupBy("label", "run").agg(F.first("ident").alias("ident"), F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f" SELECT ord, coalesce(last_value(gappy IGNORE NULLS) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(gappy IGNORE NULLS) OVER ({_w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM series", "series")
def wn08_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN08: last observation carried forward, the head filled from behind."""
    forward = order().rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("label").orderBy(F.desc("us"), F.desc("ord")).rowsBetween(W.unboundedPreceding, 0)  # reversed, so that the frame grows
    return views.series(spark, sf_dir).select("ord", F.coalesce(F.last("gappy", True).over(forward), F.last("gappy", True).over(back)).alias("filled"))


@query(f", g AS (SELECT label, (us - lag(us) OVER ({_w})) / 1e6 AS gap FROM series) SELECT label, count(*) FILTER (gap > 3600) AS gaps, round(max(gap), 6) AS longest FROM g GROUP BY label", "series")
def ag38_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG38: gaps of over an hour, and the longest."""
    g = views.series(spark, sf_dir).select("label", ((F.col("us") - F.lag("us").over(order())) / 1e6).alias("gap"))
    return g.groupBy("label").agg(F.count_if(F.col("gap") > 3600).alias("gaps"), F.round(F.max("gap"), 6).alias("longest"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY us DESC, ord DESC) AS k FROM series) SELECT label, round(max(value) - min(value), 6) AS spread FROM r WHERE k <= 3 GROUP BY label", "series")
def ag43_steady_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG43: spread of the last three samples."""
    k = F.row_number().over(W.partitionBy("label").orderBy(F.desc("us"), F.desc("ord")))
    return views.series(spark, sf_dir).withColumn("k", k).filter("k <= 3").groupBy("label").agg(F.round(F.max("value") - F.min("value"), 6).alias("spread"))


@query(f", r AS (SELECT ident, value, row_number() OVER (PARTITION BY ident ORDER BY us, ord) AS k FROM series) SELECT ident, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(1000 / median(value), 4) AS fps FROM r WHERE k > 10 GROUP BY ident", "series")
def ag34_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG34: latency figures after ten warm-up samples."""
    r = views.series(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("ident").orderBy("us", "ord"))).filter("k > 10")
    return r.groupBy("ident").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.round(1000 / F.median("value"), 4).alias("fps"))


@query(", t AS (SELECT ident, sum(value) AS total FROM series GROUP BY ident) SELECT ident, round(total, 4) AS total, round(total / sum(total) OVER (), 6) AS share FROM t", "series")
def ag35_stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG35: total and share of each stage."""
    t = views.series(spark, sf_dir).groupBy("ident").agg(F.sum("value").alias("total"))
    return t.select("ident", F.round("total", 4).alias("total"), F.round(F.col("total") / F.sum("total").over(W.partitionBy()), 6).alias("share"))


@query(", r AS (SELECT ident, ord, value, row_number() OVER (PARTITION BY ident ORDER BY value DESC, ord) AS k FROM series) SELECT ident, ord, value, CAST(k AS INTEGER) AS k FROM r WHERE k <= 5", "series")
def wn10_top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN10: the five largest of each kind."""
    k = F.row_number().over(W.partitionBy("ident").orderBy(F.desc("value"), "ord"))
    return views.series(spark, sf_dir).select("ident", "ord", "value", k.alias("k")).filter("k <= 5")


@query(f", s AS (SELECT *, first_value(value) OVER ({_w}) AS v0, row_number() OVER ({_w}) AS i FROM series) SELECT label, round(max(value / nullif(v0, 0) - 1), 4) AS worst, min(CASE WHEN value > 1.5 * v0 THEN i END) AS first_crossing FROM s GROUP BY label", "series")
def wn11_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN11: change against the first sample, and the first that exceeds it by half."""
    s = views.series(spark, sf_dir).withColumn("v0", F.first("value").over(order())).withColumn("i", F.row_number().over(order()).cast("long"))
    return s.groupBy("label").agg(F.round(F.max(F.col("value") / F.nullif("v0", F.lit(0.0)) - 1), 4).alias("worst"), F.min(F.when(F.col("value") > 1.5 * F.col("v0"), F.col("i"))).alias("first_crossing"))


@query(f" SELECT ord, round(sum(value) OVER ({_w}) / nullif(sum(value) OVER (PARTITION BY label), 0), 6) AS phase FROM series", "series")
def wn12_time_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN12: running sum as a share of the whole."""
    return views.series(spark, sf_dir).select("ord", F.round(F.sum("value").over(order().rowsBetween(W.unboundedPreceding, 0)) / F.nullif(F.sum("value").over(W.partitionBy("label")), F.lit(0.0)), 6).alias("phase"))


@query(", n AS (SELECT label, avg(value) AS m, CASE WHEN stddev_pop(value) < 1e-9 THEN 1 ELSE stddev_pop(value) END AS s FROM series GROUP BY label) SELECT ord, round((value - m) / s, 6) AS z FROM series JOIN n USING (label)", "series")
def ts10_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS10: distance from the label's mean in deviations (a vanishing deviation counts as one)."""
    per = W.partitionBy("label")
    s = F.stddev_pop("value").over(per)
    return views.series(spark, sf_dir).select("ord", F.round((F.col("value") - F.avg("value").over(per)) / F.when(s < 1e-9, 1.0).otherwise(s), 6).alias("z"))


_gauss = "[" + ", ".join(f"exp(-0.5 * pow({k} / 1.5, 2))" for k in range(-4, 5)) + "]"


@query(f", s AS (SELECT label, ord, value, row_number() OVER ({_w}) AS i, count(*) OVER (PARTITION BY label) AS n FROM series), k AS (SELECT o, {_gauss}[o + 5] AS w FROM generate_series(-4, 4) t(o)) SELECT s.ord AS ord, round(sum(w * x.value) / sum(w), 6) AS smooth FROM s, k, s x WHERE x.label = s.label AND x.i = greatest(1, least(s.n, s.i + o)) GROUP BY s.ord", "series")
def ts01_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS01: Gaussian low-pass, the ends held. Offsets fan out rows, so one equality join by (label, place) suffices."""
    s = views.series(spark, sf_dir).select("label", "ord", "value", F.row_number().over(order()).alias("i"), F.count("*").over(W.partitionBy("label")).alias("n"))
    fan = s.withColumn("o", F.explode(F.sequence(F.lit(-4), F.lit(4)))).select("label", "ord", F.exp(-0.5 * F.pow(F.col("o") / 1.5, F.lit(2.0))).alias("w"), F.greatest(F.lit(1), F.least("n", F.col("i") + F.col("o"))).alias("i"))
    return fan.join(s.select("label", "i", "value"), ["label", "i"]).groupBy("ord").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("smooth"))


#: Microseconds of an hour.
HOUR = 3_600_000_000


@query(", i AS (SELECT ord AS iteration, us AS hi, us - CAST(value * 60000000 AS BIGINT) AS lo, ident FROM series) SELECT iteration, count(s.ord) AS samples, round(avg(s.value), 6) AS mean FROM i LEFT JOIN series s ON s.ident = i.ident AND s.us BETWEEN lo AND hi GROUP BY iteration", "series")
def jn05_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN05: samples within each iteration's interval, as the difference of running counts and sums at its two ends.

    Both ends stand among the samples of their hour; what came in earlier hours is added from a table of hours, in decimals, so that
    differences are exact. No interval is paired with its samples, however dense they are.
    """
    s = views.series(spark, sf_dir)
    i = s.select(F.col("ord").alias("iteration"), F.col("us").alias("hi"), (F.col("us") - (F.col("value") * 60000000).cast("long")).alias("lo"), "ident")
    right = F.col("lo") <= F.col("hi")  # false or unknown: nothing lies within
    ends = F.array(F.struct(F.col("hi").alias("us"), F.lit(1).alias("sign")), F.struct(F.when(right, F.col("lo") - 1).otherwise(F.col("hi")).alias("us"), F.lit(-1).alias("sign")))
    ends = i.select("ident", "iteration", F.explode(ends).alias("e")).select("ident", "iteration", "e.us", "e.sign", F.lit(0).alias("n"), F.lit(None).cast("double").alias("value"))
    own = s.select("ident", F.lit(None).cast("long").alias("iteration"), "us", F.lit(0).alias("sign"), F.lit(1).alias("n"), "value")
    rows = own.unionByName(ends).withColumn("hour", F.expr(f"us div {HOUR}"))
    hours = rows.groupBy("ident", "hour").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(30, 12)")).alias("v"), F.count("value").alias("k"))
    earlier = W.partitionBy("ident").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    hours = hours.select(F.col("ident").alias("kind"), F.col("hour").alias("at"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "nvk"])
    upto = W.partitionBy("ident", "hour").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    run = rows.select("ident", "hour", "iteration", "sign", *[F.coalesce(c.over(upto), F.lit(0)).alias(n) for n, c in (("n", F.sum("n")), ("v", F.sum("value")), ("k", F.count("value")))]).filter("sign <> 0")
    met = run.join(hours, F.col("ident").eqNullSafe(F.col("kind")) & F.col("hour").eqNullSafe(F.col("at")))
    known = F.col("ident").isNotNull().cast("int") * F.col("sign")
    total = met.groupBy("iteration").agg(F.sum(known * (F.col("n") + F.col("n0"))).alias("samples"), F.sum(known * (F.col("k") + F.col("k0"))).alias("k"), (F.sum(known * F.col("v")) + F.sum(known * F.col("v0")).cast("double")).alias("v"))
    return total.select("iteration", "samples", F.round(F.when(F.col("k") > 0, F.col("v") / F.col("k")), 6).alias("mean"))


@query(", a AS (SELECT * FROM series WHERE ident = 'click'), c AS (SELECT s.ord AS ord, a.ord AS near, abs(a.us - s.us) AS dt, row_number() OVER (PARTITION BY s.ord ORDER BY abs(a.us - s.us), a.us, a.ord) AS k FROM series s JOIN a ON a.label = s.label WHERE s.ident <> 'click') SELECT ord, near, dt FROM c WHERE k = 1 AND dt <= 86400000000", "series")
def jn06_nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN06, FLT15: the nearest annotation in time, if not staler than a day; of equals the earlier. No pairs are built."""
    s = views.series(spark, sf_dir)
    mark = F.when(F.col("ident") == "click", F.struct("us", "ord"))
    # annotations at the same instant: those before a sample reach it from behind, the smallest number wins from ahead
    before = W.partitionBy("label").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("label").orderBy(F.desc("us")).rangeBetween(W.unboundedPreceding, 0)  # reversed, so that the frame grows
    m = s.withColumn("m", mark)
    late = F.max(F.col("m.us")).over(before)
    m = m.withColumn("pu", late).withColumn("nu", F.min(F.col("m.us")).over(after))
    pick = F.when(F.col("nu").isNull() | (F.col("us") - F.col("pu") <= F.col("nu") - F.col("us")), F.col("pu")).otherwise(F.col("nu"))
    m = m.filter("ident <> 'click'").select("ord", "label", "us", pick.alias("at")).filter("at is not null and abs(at - us) <= 86400000000")
    a = s.filter("ident = 'click'").groupBy("label", F.col("us").alias("at")).agg(F.min("ord").alias("near"))
    return m.join(a, ["label", "at"]).select("ord", "near", F.abs(F.col("at") - F.col("us")).alias("dt"))


@query(", l AS (SELECT clip, n, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) AS i, count(*) OVER (PARTITION BY clip) AS len FROM frames), v AS (SELECT l.*, k FROM l, generate_series(1, 3) t(k)), r AS (SELECT clip, k, len, i - row_number() OVER (PARTITION BY clip, k ORDER BY i) AS g FROM v WHERE n >= k), s AS (SELECT clip, k, len, g, count(*) AS run FROM r GROUP BY ALL), b AS (SELECT clip, max(k) AS k FROM s WHERE run >= least(2, len) GROUP BY clip) SELECT clip, CAST(coalesce(max(b.k), 0) AS INTEGER) AS sustained FROM frames LEFT JOIN b USING (clip) GROUP BY clip", "frames")
def ag18_sustained_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: the largest number of people held, or exceeded, for two frames running (or all of a shorter clip)."""
    per = W.partitionBy("clip")
    l = views.frames(spark, sf_dir).withColumn("i", F.row_number().over(per.orderBy("frame"))).withColumn("len", F.count("*").over(per))
    v = l.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("n >= k")
    s = v.withColumn("g", F.col("i") - F.row_number().over(W.partitionBy("clip", "k").orderBy("i"))).groupBy("clip", "k", "len", "g").count()
    held = F.when((F.col("count") >= F.least(F.lit(2), "len")) | (F.col("k") == 0), F.col("k"))
    return s.groupBy("clip").agg(F.max(held).alias("sustained"))


@query(", r AS (SELECT clip, n, row_number() OVER (PARTITION BY clip ORDER BY frame) - row_number() OVER (PARTITION BY clip, n ORDER BY frame) AS g FROM frames), s AS (SELECT clip, n, g, count(*) AS run FROM r GROUP BY ALL), b AS (SELECT clip, max(n) FILTER (run >= 2) AS n FROM s GROUP BY clip), m AS (SELECT clip, CAST(floor(median(n)) AS INTEGER) AS m FROM frames GROUP BY clip) SELECT clip, greatest(1, coalesce(b.n, m.m)) AS people FROM b JOIN m USING (clip)", "frames")
def ag19_exact_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19: the largest number held exactly for two frames; else the median; one at least."""
    f = views.frames(spark, sf_dir)
    g = F.row_number().over(W.partitionBy("clip").orderBy("frame")) - F.row_number().over(W.partitionBy("clip", "n").orderBy("frame"))
    b = f.withColumn("g", g).groupBy("clip", "n", "g").count().groupBy("clip").agg(F.max(F.when(F.col("count") >= 2, F.col("n"))).alias("b"))
    m = f.groupBy("clip").agg(F.floor(F.median("n")).cast("int").alias("m"))
    return b.join(m, "clip").select("clip", F.greatest(F.lit(1), F.coalesce("b", "m")).alias("people"))


@query(", r AS (SELECT *, n > 0 AS drawn, row_number() OVER (PARTITION BY clip ORDER BY frame) - row_number() OVER (PARTITION BY clip, n > 0 ORDER BY frame) AS g FROM frames) SELECT clip, frame, drawn AND count(*) OVER (PARTITION BY clip, drawn, g) >= 2 AS kept FROM r", "frames")
def flt08_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT08: what is drawable for fewer than two frames running is suppressed."""
    r = views.frames(spark, sf_dir).withColumn("drawn", F.col("n") > 0)
    r = r.withColumn("g", F.row_number().over(W.partitionBy("clip").orderBy("frame")) - F.row_number().over(W.partitionBy("clip", "drawn").orderBy("frame")))
    return r.select("clip", "frame", (F.col("drawn") & (F.count("*").over(W.partitionBy("clip", "drawn", "g")) >= 2)).alias("kept"))
