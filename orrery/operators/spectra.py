"""Spectra of whole series: a task walks through sorted rows and transforms one series at a time (numpy's FFT)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.clips import walk
from orrery.plans.registry import query
from orrery.sources import views

#: Samples a second, the band of a walk's cadence (Hz), and samples that a series needs.
RATE, BAND, LEAST = 10.0, (0.5, 3.0), 16


def detrended(x: np.ndarray) -> np.ndarray:
    """Less the straight line of least squares."""
    i = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - i * (i @ x) / max(1.0, i @ i)


def dominant(x: np.ndarray, rate: float = RATE, band: tuple[float, float] = BAND) -> tuple[float, float]:
    """(Hz, share): the strongest frequency in the band, of equals the lowest, and its share of all power but the constant's.

    (0, 0) for a series of under LEAST samples, one that is flat after its trend, or one without a frequency in the band.
    """
    n = len(x)
    if n < LEAST or (y := detrended(x)).std() < 1e-9:
        return 0.0, 0.0
    power = np.abs(np.fft.rfft(y * np.hanning(n))) ** 2
    hz = np.arange(len(power)) * rate / n
    inside = np.flatnonzero((hz >= band[0] - 1e-12) & (hz <= band[1] + 1e-12))
    whole = power[1:].sum()
    if not len(inside) or whole <= 0:
        return 0.0, 0.0
    k = inside[power[inside] >= power[inside].max() * (1 - 1e-9)][0]
    return float(hz[k]), float(power[k] / whole)


def shape(x: np.ndarray) -> np.ndarray:
    """Amplitudes by frequency, adding up to one; the mean is taken off before."""
    a = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x))))
    return a / (a.sum() + 1e-9)


_hann = "(0.5 - 0.5 * cos(2 * pi() * i / (n - 1)))"
_numbered = ", s AS (SELECT label, value, {} row_number() OVER (PARTITION BY label ORDER BY us, ord) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM series)"


@query(
    _numbered.format("") + f""",
l AS (SELECT label, any_value(n) AS n, avg(value) AS m, regr_slope(value, i) AS b FROM s GROUP BY label HAVING any_value(n) >= {LEAST}),
d AS (SELECT s.label, s.n, i, value - m - b * (i - (s.n - 1) / 2.0) AS x FROM s JOIN l USING (label)),
t AS (SELECT label, n, i, x, x * {_hann} AS y FROM d),
q AS (SELECT label, any_value(n) AS n, stddev_pop(x) AS sd, n * sum(y * y) AS s2, pow(sum(y), 2) AS first, CASE WHEN n % 2 = 0 THEN pow(sum(CASE WHEN i % 2 = 0 THEN y ELSE -y END), 2) ELSE 0 END AS last FROM t GROUP BY label, n),
k AS (SELECT label, n, unnest(range(CAST(ceil({BAND[0]} * n / {RATE} - 1e-9) AS BIGINT), least(n // 2, CAST(floor({BAND[1]} * n / {RATE} + 1e-9) AS BIGINT)) + 1)) AS k FROM q WHERE sd >= 1e-9),
p AS (SELECT t.label, k, pow(sum(y * cos(2 * pi() * k * i / t.n)), 2) + pow(sum(y * sin(2 * pi() * k * i / t.n)), 2) AS p FROM t JOIN k ON k.label = t.label GROUP BY t.label, k),
m AS (SELECT label, max(p) AS p FROM p GROUP BY label),
g AS (SELECT p.label, min(k) AS k, any_value(m.p) AS p FROM p JOIN m ON m.label = p.label AND p.p >= m.p * (1 - 1e-9) GROUP BY p.label)
SELECT a.label, round(coalesce(k * {RATE} / q.n, 0), 6) AS hz, round(coalesce(p / ((s2 - first + last) / 2), 0), 5) AS share
FROM (SELECT DISTINCT label FROM series) a LEFT JOIN q ON q.label = a.label LEFT JOIN g ON g.label = a.label""",
    "series",
)
def ts06_dominant_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS06: the strongest frequency of each series between 0.5 and 3 Hz (detrended, Hann window), and its share of the power.

    Samples go by (time, id); short and flat series give 0 and 0; an empty table gives none.
    """

    def start():
        return lambda rows: [(rows[0][0], *dominant(np.array([r[3] for r in rows], float)))]

    s = views.series(spark, sf_dir).select("label", "us", "ord", "value").filter("value IS NOT NULL")
    found = walk(s, "label", ["us", "ord"], [], start, "label long, hz double, share double")
    return found.select("label", F.round("hz", 6).alias("hz"), F.round("share", 5).alias("share"))


@query(
    _numbered.format("coalesce(gappy, 0) AS other,") + f""",
m AS (SELECT label, any_value(n) AS n, avg(value) AS a, avg(other) AS b FROM s GROUP BY label HAVING any_value(n) >= {LEAST}),
t AS (SELECT s.label, s.n, i, (value - a) * {_hann.replace("n ", "s.n ")} AS y, (other - b) * {_hann.replace("n ", "s.n ")} AS z FROM s JOIN m USING (label)),
k AS (SELECT label, n, unnest(range(0, n // 2 + 1)) AS k FROM m),
p AS (SELECT t.label, k, sqrt(pow(sum(y * cos(2 * pi() * k * i / t.n)), 2) + pow(sum(y * sin(2 * pi() * k * i / t.n)), 2)) AS y,
             sqrt(pow(sum(z * cos(2 * pi() * k * i / t.n)), 2) + pow(sum(z * sin(2 * pi() * k * i / t.n)), 2)) AS z FROM t JOIN k ON k.label = t.label GROUP BY t.label, k),
w AS (SELECT label, sum(y) + 1e-9 AS y, sum(z) + 1e-9 AS z FROM p GROUP BY label)
SELECT p.label, round(sum(abs(p.y / w.y - p.z / w.z)), 5) AS spectrum_l1, round(any_value(abs(b - a) / (abs(a) + 1e-9)), 6) AS level_shift
FROM p JOIN w ON w.label = p.label JOIN m ON m.label = p.label GROUP BY p.label""",
    "series",
)
def ag51_spectrum_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG51: how far a second arm of a series (the same with gaps set to 0) moves its spectrum (L1, 0 to 2), and its level relatively.

    Series of under LEAST samples are left out.
    """

    def start():
        def call(rows: list[tuple]) -> list[tuple]:
            if len(rows) < LEAST:
                return []
            a, b = (np.array([r[k] for r in rows], float) for k in (3, 4))
            return [(rows[0][0], float(np.abs(shape(a) - shape(b)).sum()), float(abs(b.mean() - a.mean()) / (abs(a.mean()) + 1e-9)))]

        return call

    s = views.series(spark, sf_dir).select("label", "us", "ord", "value", F.coalesce("gappy", F.lit(0.0)).alias("other")).filter("value IS NOT NULL")
    found = walk(s, "label", ["us", "ord"], [], start, "label long, spectrum_l1 double, level_shift double")
    return found.select("label", F.round("spectrum_l1", 5).alias("spectrum_l1"), F.round("level_shift", 6).alias("level_shift"))
