"""Readers of observation files: what is malformed is counted or left out as stated, never silently mixed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Joints of a pose row; each has x, y and a confidence.
JOINTS = 17


def with_line(df: DataFrame) -> DataFrame:
    """Adds the file's name and an ordinal that grows with the order of a file's lines."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def tracklets(spark: SparkSession, path: str, subjects: list[int] | None = None, least: int = 61) -> DataFrame:
    """SRC01: pose CSVs under folders ``subject-status-sequence-angle``: (subject, status, seq, angle, frames, bad, poses).

    The name is parsed and subjects are chosen before any line is split. A line of another width than three values a joint,
    or with something that is no number, counts as bad; sequences of under ``least`` good rows go. poses: array of frames in
    the file's order, each an array of 51 doubles. The header is one line a file. An empty folder gives no rows.
    """
    raw = with_line(spark.read.option("recursiveFileLookup", "true").text(path)).withColumnRenamed("value", "text")
    key = F.regexp_extract("file", r"/([0-9]+)-(nm|bg|cl)-([0-9]+)-([0-9]+)/[^/]*$", 0)
    part = lambda k: F.regexp_extract("file", r"/([0-9]+)-(nm|bg|cl)-([0-9]+)-([0-9]+)/[^/]*$", k)
    rows = raw.filter(key != "").select(part(1).cast("int").alias("subject"), part(2).alias("status"), part(3).cast("int").alias("seq"), part(4).cast("int").alias("angle"), "file", "line", "text")
    if subjects is not None:
        rows = rows.filter(F.col("subject").isin(subjects))
    rows = rows.filter(~F.lower("text").startswith("frame") & ~F.lower("text").startswith("x0"))
    values = F.transform(F.split("text", ","), lambda x: x.try_cast("double"))
    rows = rows.withColumn("v", values).withColumn("good", (F.size("v") == 3 * JOINTS) & ~F.exists("v", lambda x: x.isNull()))
    out = rows.groupBy("subject", "status", "seq", "angle").agg(
        F.count_if("good").alias("frames"), F.count_if(~F.col("good")).alias("bad"), F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("file", "line", "v")))).alias("p")
    )
    return out.filter(F.col("frames") >= least).withColumn("poses", F.transform("p", lambda p: p["v"])).drop("p")


def cached_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC05: vectors named ``arm::subject|status|seq|angle`` (Parquet: name, v); names of another form go."""
    df = spark.read.parquet(path)
    key = F.split(F.try_element_at(F.split("name", "::"), F.lit(2)), r"\|")
    good = df.filter((F.size(F.split("name", "::")) == 2) & (F.size(key) == 4))
    return good.select(F.split("name", "::")[0].alias("arm"), *[key[i].try_cast("int").alias(n) for i, n in enumerate(("subject", "status", "seq", "angle"))], "v")


def arm_items(spark: SparkSession, path: str, manifest: str, banned: DataFrame, least: int = 24) -> DataFrame:
    """SRC03, SRC04: sequences of an arm (Parquet: clip, arm, frame, v) with their manifest's identity and condition
    (Parquet: clip, identity, condition); banned clips (clip) go, so do sequences of under ``least`` frames."""
    rows = spark.read.parquet(path).join(banned.select("clip").distinct(), "clip", "left_anti")
    long_ones = rows.groupBy("arm", "clip").agg(F.count("*").alias("frames")).filter(F.col("frames") >= least)
    return long_ones.join(spark.read.parquet(manifest).select("clip", "identity", "condition"), "clip")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """SRC07: JSON lines of (clip, epsilon, values[]) among other lines; what is no such object goes. One row a value."""
    raw = spark.read.text(path).select(F.from_json("value", "clip string, epsilon double, values array<double>", {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return raw.filter("clip is not null and values is not null").select("clip", "epsilon", F.posexplode("values").alias("i", "value")).filter("value is not null")


def samples(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """SRC08: sample CSVs (iso, label, watts): rows whose label begins so; rows whose time cannot be read go."""
    df = spark.read.option("header", "true").schema("iso string, label string, watts string").csv(path)
    return df.filter(F.col("label").startswith(prefix)).select(F.try_to_timestamp("iso").alias("ts"), "label", F.col("watts").try_cast("double").alias("watts")).filter("ts is not null")


def iterations(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """SRC09: JSON lines of one phase; of several with one time the first in its file holds. In order of time."""
    df = spark.read.schema("phase string, ts string, ms long, frames int").json(path)
    df = with_line(df).filter((F.col("phase") == phase) & F.col("ts").isNotNull())
    first = F.row_number().over(W.partitionBy("ts").orderBy("file", "line"))
    return df.withColumn("k", first).filter("k = 1").select("phase", "ts", "ms", "frames").orderBy("ts")


def device_facts(text: Column) -> Column:
    """SRC10, FN48: temperature (tenths), level, busy share and steps out of a command's text; null where absent."""
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("double")
    return F.struct(
        (number(r"temperature: *(-?[0-9]+)") / 10).alias("celsius"), number(r"level: *([0-9]+)").alias("level"),
        number(r"busy *[:=] *([0-9.]+) *%").alias("busy"), F.transform(F.regexp_extract_all(text, F.lit(r"step ([0-9]+)"), 1), lambda x: x.try_cast("int")).alias("steps"),
    )


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """SRC06: (video, frame, x1, y1, x2, y2) of files named ``<video>_frame<number>_output.json``, each a list of objects with ``bbox_xyxy``.

    A frame without boxes gives a row of nulls, so that it counts as annotated. Files of other names, and those that are no list
    of such objects, give none; of a video's name all but the last ``_frame`` belongs to it.
    """
    doc = spark.read.option("pathGlobFilter", "*_output.json").text(path, wholetext=True)
    doc = doc.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_frame([0-9]+)_output\.json$", 0).alias("name"), "value").filter("name <> ''")
    part = lambda k: F.regexp_extract("name", r"^(.*)_frame([0-9]+)_output\.json$", k)
    boxes = F.from_json("value", "array<struct<bbox_xyxy: array<double>>>", {"mode": "PERMISSIVE"})
    doc = doc.select(part(1).alias("video"), part(2).cast("long").alias("frame"), boxes.alias("boxes"))
    doc = doc.filter("boxes is not null and forall(boxes, b -> b.bbox_xyxy is not null and size(b.bbox_xyxy) >= 4)")
    rows = doc.select("video", "frame", F.explode_outer("boxes.bbox_xyxy").alias("b"))
    return rows.select("video", "frame", *[F.get("b", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC14: nodes (graph, id, type, mode) and edges (graph, link, src, src_slot, dst, dst_slot) of graphs kept as JSON, a document a file."""
    kind = "nodes array<struct<id: string, type: string, mode: int>>, links array<array<string>>"
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("graph"), F.from_json("value", kind).alias("d"))
    nodes = doc.select("graph", F.explode("d.nodes").alias("n")).select("graph", "n.id", "n.type", F.coalesce("n.mode", F.lit(0)).alias("mode"))
    at = lambda i: F.col("l")[i]
    links = doc.select("graph", F.explode("d.links").alias("l")).filter(F.size("l") >= 5)
    edges = links.select("graph", at(0).alias("link"), at(1).alias("src"), at(2).cast("int").alias("src_slot"), at(3).alias("dst"), at(4).cast("int").alias("dst_slot"))
    return nodes, edges


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: an inventory CSV's kept clips of one identity, but for those of subjects whose names begin with p00."""
    df = spark.read.option("header", "true").schema("filename string, status string, n_identities int, identities string, condition string, source_relpath string").csv(path)
    return df.filter("status = 'KEPT' AND n_identities = 1 AND NOT identities LIKE 'p00%'").select(F.col("filename").alias("clip"), F.col("identities").alias("identity"), "condition", "source_relpath")


def layers(files: DataFrame) -> DataFrame:
    """SRC23: files named ``p<k>.mp4`` with the alpha ``p<k>_alpha.mp4`` of the same number, if there is one: (k, name, alpha)."""
    f = files.select("name", F.regexp_extract("name", r"^p([0-9]+)(_alpha)?\.mp4$", 1).try_cast("int").alias("k"), F.col("name").contains("_alpha").alias("is_alpha")).filter("k is not null")
    return f.filter("NOT is_alpha").select("k", "name").join(f.filter("is_alpha").select("k", F.col("name").alias("alpha")), "k", "left")


def still_to_do(clips: DataFrame, status: DataFrame) -> DataFrame:
    """SRC25: clips that no row of the status table calls done; failures are to be done again."""
    return clips.join(status.filter("ok").select("clip").distinct(), "clip", "left_anti")
