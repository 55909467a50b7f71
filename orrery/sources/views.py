"""Observation tables that stand on the driver's tables, by the same rules in Spark and (VIEWS) in plain SQL.

emb: embeddings of sequences by subject, status, sequence number and view angle. item: embeddings by identity, condition
and collection. box: detections in frames. series: samples of a value by label. px: mask pixels of two kinds, by frame (a run of order keys). kp: joints. pose: joints along clips.
frames: people by frame of a clip. edge: a processing graph. expect: expected against measured values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order keys that share a frame of pixels: frames grow in number with the table, and not in size.
ORDERS = 375

VIEWS = {
    "emb": "SELECT vec_id AS ord, label AS subject, CAST(vec_id % 3 AS INTEGER) AS status, CAST(1 + (vec_id // 3) % 6 AS INTEGER) AS seq, CAST(18 * (vec_id % 11) AS INTEGER) AS angle, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
    "item": "SELECT vec_id AS ord, label AS ident, CAST(vec_id % 4 AS INTEGER) AS cond, CAST(vec_id % 2 AS INTEGER) AS coll, vec_id // 7 AS source, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
    "box": "SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS det, l_returnflag AS kind, CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST((l_suppkey * 37) % 300 AS DOUBLE) AS y1, CAST(l_partkey % 600 + 20 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS x2, CAST((l_suppkey * 37) % 300 + 40 + l_partkey % 120 AS DOUBLE) AS y2, 1 - CAST(l_discount AS DOUBLE) AS score FROM lineitem",
    "series": "SELECT user_id AS label, epoch_us(ts) AS us, event_id AS ord, event_type AS ident, CAST(value AS DOUBLE) AS value, CASE WHEN event_id % 10 <> 0 THEN CAST(value AS DOUBLE) END AS gappy FROM events",
    "px": "SELECT DISTINCT CASE WHEN l_returnflag = 'N' THEN 'raw' ELSE 'out' END AS kind, CAST(l_orderkey // 375 AS INTEGER) AS frame, CAST(l_partkey % 24 AS INTEGER) AS y, CAST((l_suppkey + l_linenumber * 5) % 24 AS INTEGER) AS x FROM lineitem",
    "kp": "SELECT l_orderkey AS frame, CAST(l_partkey % 17 AS INTEGER) AS joint, avg(CAST(l_partkey % 600 AS DOUBLE)) AS x, avg(CAST((l_suppkey * 37) % 300 AS DOUBLE)) AS y, max(1 - CAST(l_tax AS DOUBLE) * 10) AS conf FROM lineitem GROUP BY 1, 2",
    "pose": "SELECT l_orderkey // 4096 AS clip, CAST(l_orderkey % 64 AS INTEGER) AS frame, CAST(l_partkey % 17 AS INTEGER) AS joint, avg(CAST(l_partkey % 600 AS DOUBLE)) AS x, avg(CAST((l_suppkey * 37) % 300 AS DOUBLE)) AS y FROM lineitem GROUP BY 1, 2, 3",
    "frames": "SELECT conv_id AS clip, turn AS frame, role AS ident, CAST(length(text) % 4 AS INTEGER) AS n FROM conversations",
    "edge": "SELECT p_partkey AS node, p_partkey // 2 AS parent, p_brand AS class, p_size % 5 = 0 AS muted FROM part",
    "expect": "SELECT n_name AS arm, CAST(n_nationkey * 100 + 3000 AS DOUBLE) AS expected, 1500.0::DOUBLE AS tol, n_nationkey AS k FROM nation",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doubles(name: str):
    return F.transform(name, lambda x: x.cast("double"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS ord", "label AS subject", "cast(vec_id % 3 AS int) AS status", "cast(1 + (vec_id div 3) % 6 AS int) AS seq", "cast(18 * (vec_id % 11) AS int) AS angle", "transform(embedding, x -> cast(x AS double)) AS v"
    )


def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS ord", "label AS ident", "cast(vec_id % 4 AS int) AS cond", "cast(vec_id % 2 AS int) AS coll", "vec_id div 7 AS source", "transform(embedding, x -> cast(x AS double)) AS v"
    )


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("det", F.row_number().over(order).cast("long")).selectExpr(
        "l_orderkey AS frame", "det", "l_returnflag AS kind", "cast(l_partkey % 600 AS double) AS x1", "cast((l_suppkey * 37) % 300 AS double) AS y1",
        "cast(l_partkey % 600 + 20 + cast(l_quantity AS bigint) AS double) AS x2", "cast((l_suppkey * 37) % 300 + 40 + l_partkey % 120 AS double) AS y2", "1 - cast(l_discount AS double) AS score",
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS label", "unix_micros(cast(ts AS timestamp)) AS us", "event_id AS ord", "event_type AS ident", "cast(value AS double) AS value", "CASE WHEN event_id % 10 <> 0 THEN cast(value AS double) END AS gappy"
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px_rows(spark, sf_dir).distinct()


def px_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``px`` with its repeats, for what does not mind them."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_returnflag = 'N' THEN 'raw' ELSE 'out' END AS kind", f"cast(l_orderkey div {ORDERS} AS int) AS frame", "cast(l_partkey % 24 AS int) AS y", "cast((l_suppkey + l_linenumber * 5) % 24 AS int) AS x"
    )


def frame_count(pixels: DataFrame) -> DataFrame:
    """One row: ``frames``, how many there are, with those that have no pixel before the last."""
    return pixels.agg((F.max("frame") + 1).alias("frames"))


def kp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.expr("cast(l_partkey % 17 AS int)").alias("joint"))
    return rows.agg(F.expr("avg(cast(l_partkey % 600 AS double)) AS x"), F.expr("avg(cast((l_suppkey * 37) % 300 AS double)) AS y"), F.expr("max(1 - cast(l_tax AS double) * 10) AS conf"))


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 4096 AS clip", "cast(l_orderkey % 64 AS int) AS frame", "cast(l_partkey % 17 AS int) AS joint", "cast(l_partkey % 600 AS double) AS x", "cast((l_suppkey * 37) % 300 AS double) AS y")
    return rows.groupBy("clip", "frame", "joint").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS clip", "turn AS frame", "role AS ident", "cast(length(text) % 4 AS int) AS n")


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS node", "p_partkey div 2 AS parent", "p_brand AS class", "p_size % 5 = 0 AS muted")


def expect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_name AS arm", "cast(n_nationkey * 100 + 3000 AS double) AS expected", "1500.0D AS tol", "n_nationkey AS k")
