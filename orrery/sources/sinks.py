"""Where results go: partitioned tables, appended logs and nested exports. Every writer leaves the work to the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.sources import views


def write_arms(df: DataFrame, path: str, *by: str) -> None:
    """SNK01: a table in one folder per arm; arms written again are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    """SNK02, SNK03: one JSON object per row, added to what is there."""
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """SNK04: rows as CSV, added to what is there; every file names its columns, so reading with a header gives rows only."""
    df.write.mode("append").option("header", True).csv(path)


@query(
    " SELECT clip, frame, count(*) AS joints, CAST(to_json(list(struct_pack(joint := joint, x := CAST(floor(x) AS BIGINT), y := CAST(floor(y) AS BIGINT)) ORDER BY joint)) AS VARCHAR) AS body FROM pose GROUP BY clip, frame",
    "pose",
)
def snk06_pose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK06: the joints of every frame as one nested JSON value, in order (17 at most: a bounded group)."""
    row = F.struct("joint", F.floor("x").cast("long").alias("x"), F.floor("y").cast("long").alias("y"))
    g = views.pose(spark, sf_dir).groupBy("clip", "frame").agg(F.count("*").alias("joints"), F.sort_array(F.collect_list(row)).alias("b"))
    return g.select("clip", "frame", "joints", F.to_json("b").alias("body"))


def report(df: DataFrame, path: str, most: int = 1000) -> None:
    """SNK05: a table of a report as Markdown, in one file. Only for results of ``most`` rows at most; more are an error."""
    if df.count() > most:
        raise ValueError(f"a report holds {most} rows at most")
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([(f"| {' | '.join(df.columns)} |",), (f"|{'-|' * len(df.columns)}",)], "value string")
    head.coalesce(1).union(body).coalesce(1).write.mode("overwrite").text(path)
