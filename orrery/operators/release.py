"""Private release of signals, encryption and packets."""

from __future__ import annotations

import secrets
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.exprs import clamp, uniform
from orrery.plans.registry import query
from orrery.sources import views

_w = "PARTITION BY label ORDER BY us, ord"
_amp = ", n AS (SELECT label, count(*) AS t FROM series GROUP BY label), c AS (SELECT label, t, i, sum(1.0 / (least(t - 1, j + 2) - greatest(0, j - 2) + 1)) AS a FROM n, generate_series(0, 400) s(i), generate_series(-2, 2) d(k), LATERAL (SELECT i + k AS j) WHERE i < t AND j >= 0 AND j < t GROUP BY label, t, i)"


@query(_amp + ", m AS (SELECT label, t, max(a) AS amp FROM c GROUP BY label, t) SELECT label, t, round(amp, 6) AS amplification, round((amp + least(t, 5) / 31.0) * 100, 6) AS delta FROM m", "series")
def dp03_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN13, DP03, DP04: how far one sample can move a centred mean of five, for each label's length, and the release's bound.

    One sample touches the means around it only; lengths repeat, so each different length is worked out once.
    """
    n = views.series(spark, sf_dir).groupBy("label").agg(F.count("*").alias("t"))
    lengths = n.select("t").distinct()
    i = lengths.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1))).withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") - 2), F.least(F.col("t") - 1, F.col("i") + 2))))
    width = F.least(F.col("t") - 1, F.col("j") + 2) - F.greatest(F.lit(0), F.col("j") - 2) + 1
    m = i.groupBy("t", "i").agg(F.sum(1.0 / width).alias("a")).groupBy("t").agg(F.max("a").alias("amp"))
    return n.join(m, "t").select("label", "t", F.round("amp", 6).alias("amplification"), F.round((F.col("amp") + F.least("t", F.lit(5)) / 31.0) * 100, 6).alias("delta"))


@query(f", c AS (SELECT *, greatest(0, least(100, value)) AS v FROM series WHERE gappy IS NOT NULL), m AS (SELECT label, us, ord, avg(v) OVER ({_w} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM c) SELECT ord, round(round_even(round(greatest(0, least(100, m)) / (100 / 31.0), 9), 0) * (100 / 31.0), 5) AS released FROM m", "series")
def dp02_release_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DP02, FN10-FN12: clamp, mean, clamp, 32 public levels. Absent samples are never released; noise comes last (dp01)."""
    w = W.partitionBy("label").orderBy("us", "ord").rowsBetween(-2, 2)
    c = views.series(spark, sf_dir).filter("gappy IS NOT NULL").withColumn("m", F.avg(clamp(F.col("value"), 0.0, 100.0)).over(w))
    step = 100 / 31.0
    return c.select("ord", F.round(F.bround(F.round(clamp(F.col("m"), 0.0, 100.0) / step, 9), 0) * step, 5).alias("released"))


@query(", u AS (SELECT ord, CAST(('0x' || substr(md5(concat_ws('|', 'laplace', ord)), 1, 8)) AS BIGINT) / 4294967296.0 - 0.5 AS u FROM series) SELECT ord, round(-2.0 * sign(u) * ln(greatest(1e-12, 1 - 2 * abs(u))), 6) AS noise FROM u", "series")
def dp01_test_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DP01: Laplace noise by its inverse distribution, from a hash (tests only; a release draws from the system's generator)."""
    u = uniform(F.lit("laplace"), F.col("ord")) - 0.5
    return views.series(spark, sf_dir).select("ord", u.alias("u")).select("ord", F.round(-2.0 * F.signum("u") * F.log(F.greatest(F.lit(1e-12), 1 - 2 * F.abs("u"))), 6).alias("noise"))


def secure_laplace(scale: float):
    """DP01, RND03: noise of a real release, drawn from the system's generator for every value anew; no seed is kept or stands in a plan."""

    @F.pandas_udf("double")
    def draw(x: pd.Series) -> pd.Series:
        bits = np.frombuffer(secrets.token_bytes(8 * len(x)), np.uint64) >> np.uint64(11)
        u = (bits + 0.5) / (1 << 53) - 0.5
        return x - scale * np.sign(u) * np.log1p(-2 * np.abs(u))

    return draw.asNondeterministic()


def released(samples: DataFrame, noise, low: float = 0.0, high: float = 100.0, levels: int = 32) -> DataFrame:
    """DP02: (ord, released) of samples (label, us, ord, value): clamp, centred mean of five, clamp, public levels, noise, round.

    ``noise`` gives the column with noise added (secure_laplace(sensitivity / epsilon) for a release). Absent (null) samples stay absent.
    """
    w = W.partitionBy("label").orderBy("us", "ord").rowsBetween(-2, 2)
    step = (high - low) / (levels - 1)
    m = samples.filter("value IS NOT NULL").withColumn("m", clamp(F.avg(clamp(F.col("value"), low, high)).over(w), low, high))
    held = m.select("ord", (F.bround(F.round((F.col("m") - low) / step, 9), 0) * step + low).alias("level"))
    return held.select("ord", F.round(noise(F.col("level")), 5).alias("released"))


@query(
    f""", c AS (SELECT *, greatest(0, least(100, value)) AS v FROM series WHERE gappy IS NOT NULL), m AS (SELECT ord, avg(v) OVER ({_w} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM c),
u AS (SELECT ord, m, CAST(('0x' || substr(md5(concat_ws('|', 'laplace', ord)), 1, 8)) AS BIGINT) / 4294967296.0 - 0.5 AS u FROM m)
SELECT ord, round(round_even(round(greatest(0, least(100, m)) / (100 / 31.0), 9), 0) * (100 / 31.0) - 2.0 * sign(u) * ln(greatest(1e-12, 1 - 2 * abs(u))), 5) AS released FROM u""",
    "series",
)
def dp02_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DP02: the whole release, with noise from a hash in place of the system's, so that it can be checked."""
    u = uniform(F.lit("laplace"), F.col("ord")) - 0.5
    noise = -2.0 * F.signum(u) * F.log(F.greatest(F.lit(1e-12), 1 - 2 * F.abs(u)))
    return released(views.series(spark, sf_dir).select("label", "us", "ord", F.col("gappy").alias("value")), lambda x: x + noise)


@query(" SELECT ord, value AS back FROM series", "series")
def cr01_encrypt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CR01: AES-128-GCM and back; what cannot be authenticated fails the job."""
    key = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))
    s = views.series(spark, sf_dir).select("ord", F.aes_encrypt(F.col("value").cast("string"), key, F.lit("GCM")).alias("sealed"))
    return s.select("ord", F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string").cast("double").alias("back"))


def parse_packet(packet: bytes) -> list[tuple[int, int, bytes]]:
    """CR04: records of a packet: little-endian (frame, length) and that many bytes."""
    out, at = [], 0
    while at + 8 <= len(packet):
        frame, n = struct.unpack_from("<ii", packet, at)
        out.append((frame, n, packet[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


@query(" SELECT clip, frame, CAST(length(ident) AS INTEGER) AS size, ident AS body FROM frames", "frames")
def cr04_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CR04, SNK07: a clip's records written as one packet and read back."""

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(batch.frame, batch.ident, strict=True))
        return pd.DataFrame({"clip": [batch["clip"].iloc[0]], "packet": [b"".join(struct.pack("<ii", int(f), len(i)) + i.encode() for f, i in rows)]})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, f, n, body.decode()) for c, p in zip(batch["clip"], batch["packet"], strict=True) for f, n, body in parse_packet(p)]
            yield pd.DataFrame(rows, columns=["clip", "frame", "size", "body"])

    packets = views.frames(spark, sf_dir).select("clip", "frame", "ident").groupBy("clip").applyInPandas(build, "clip long, packet binary")
    return packets.mapInPandas(parse, "clip long, frame long, size int, body string")
