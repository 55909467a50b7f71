"""Processing graphs as node and edge rows: reachability, taint, resolution, duplicates. Paths are followed by doubling links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.tables import discard, keep
from orrery.plans.registry import query
from orrery.sources import views


def climb(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts`` (node, at, total) after following ``links`` (node, to, weight; one a node) from ``at`` until there is none.

    Links double in length each round, so a path of n steps takes about log2(n) rounds, each a written table. What still has
    links after more rounds than any path could need goes round in a circle: its ``at`` is null.
    """
    links, state = keep(links).hint("merge"), keep(starts)  # tables of the graph's size are never sent whole through the driver
    rounds = links.count().bit_length() + 1
    while rounds:
        l = links.alias("l")
        moved = state.alias("s").join(l, F.col("s.at") == F.col("l.node"), "left")
        state = keep(moved.select("s.node", F.coalesce("l.to", "s.at").alias("at"), (F.col("s.total") + F.coalesce("l.weight", F.lit(0))).alias("total")))
        if state.join(links, state["at"] == links["node"], "left_semi").isEmpty():
            return state
        m = links.alias("m")
        links = keep(l.join(m, F.col("l.to") == F.col("m.node"), "left").select("l.node", F.coalesce("m.to", "l.to").alias("to"), (F.col("l.weight") + F.coalesce("m.weight", F.lit(0))).alias("weight"))).hint("merge")
        rounds -= 1
    circle = links.select(F.col("node").alias("at"), F.lit(True).alias("circle"))
    return state.join(circle, "at", "left").select("node", F.when(F.col("circle").isNull(), F.col("at")).alias("at"), "total")


def marks_above(links: DataFrame, marks: DataFrame) -> DataFrame:
    """(node): the ``marks`` (node) and all nodes that lie above one, along ``links`` (node, to; one a node).

    Links double in length each round and marks go up along them: after k rounds all nodes within 2^k - 1 steps are marked, so a
    chain of n levels takes about log2(n) rounds. Circles end after as many rounds as the longest path could need. A round's
    tables are deleted when the next are written. Nulls mark nothing; an empty table of marks gives none.
    """
    links = keep(links.filter("node is not null and to is not null"))
    marks = keep(marks.filter("node is not null").distinct())
    rounds = links.count().bit_length() + 1
    while rounds and not links.isEmpty():
        risen = links.join(marks.hint("merge"), "node", "left_semi").select(F.col("to").alias("node"))
        more = keep(marks.unionByName(risen).distinct())
        above = links.select(F.col("node").alias("to"), F.col("to").alias("next"))
        longer = keep(links.join(above.hint("merge"), "to").select("node", F.col("next").alias("to")))
        discard(links, marks)
        links, marks, rounds = longer, more, rounds - 1
    return marks


_reach = "SELECT node, 0 AS depth FROM edge WHERE node = 1 UNION ALL SELECT e.node, r.depth + 1 FROM reach r JOIN edge e ON e.parent = r.node AND e.node <> e.parent WHERE NOT e.muted"


@query(", reach AS (" + _reach + ") SELECT node, CAST(depth AS INTEGER) AS depth FROM reach", "edge")
def gr05_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR05, JN27: nodes that the root reaches over nodes that are not muted, however deep."""
    e = views.edge(spark, sf_dir)
    ways = e.filter("NOT muted AND node <> 1").select("node", F.col("parent").alias("to"), F.lit(1).alias("weight"))
    got = climb(ways, ways.select("node", F.col("to").alias("at"), F.col("weight").alias("total"))).filter("at = 1").select("node", F.col("total").alias("depth"))
    return got.unionByName(e.filter("node = 1").select("node", F.lit(0).alias("depth")))


_taint = "SELECT node FROM edge WHERE class = 'Brand#11' UNION ALL SELECT e.node FROM taint t JOIN edge e ON e.parent = t.node AND e.node <> e.parent WHERE e.class <> 'Brand#22'"


@query(", taint(node) AS (" + _taint + ") SELECT node, count(*) AS paths FROM taint GROUP BY node", "edge")
def gr07_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR07: nodes that a source taints, unless a sanitiser stands between, and by how many sources."""
    e = views.edge(spark, sf_dir).withColumn("own", F.expr("if(class = 'Brand#11', 1L, 0L)"))
    above = e.select(F.col("node").alias("to"), F.col("own").alias("weight"))
    ways = e.filter("class <> 'Brand#22' AND node <> parent").select("node", F.col("parent").alias("to")).join(above, "to").select("node", "to", "weight")
    return climb(ways, e.select("node", F.col("node").alias("at"), F.col("own").alias("total"))).filter("total > 0").select("node", F.col("total").alias("paths"))


_up = "SELECT node, parent, 0 AS hops FROM edge UNION ALL SELECT u.node, e.parent, u.hops + 1 FROM up u JOIN edge e ON e.node = u.parent WHERE e.muted"


@query(", up AS (" + _up + "), m AS (SELECT node, parent, hops, row_number() OVER (PARTITION BY node ORDER BY hops DESC) AS k FROM up) SELECT node, parent AS source, CAST(hops AS INTEGER) AS hops FROM m WHERE k = 1", "edge")
def gr02_resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR02: the nearest ancestor that is not muted, through muted ones, however many (null: a circle of muted ones)."""
    e = views.edge(spark, sf_dir)
    ways = e.filter("muted").select("node", F.col("parent").alias("to"), F.lit(1).alias("weight"))
    return climb(ways, e.select("node", F.col("parent").alias("at"), F.lit(0).alias("total"))).select("node", F.col("at").alias("source"), F.col("total").alias("hops"))


@query(", c AS (SELECT node, parent, min(node) OVER (PARTITION BY class, parent // 8) AS keep FROM edge) SELECT c.node AS node, c.keep AS keep, coalesce(p.keep, c.parent) AS parent FROM c LEFT JOIN c p ON p.node = c.parent", "edge")
def gr06_merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR06: nodes of one class and input become the first of them, and edges follow."""
    e = views.edge(spark, sf_dir)
    first = e.groupBy("class", F.expr("parent div 8 AS part")).agg(F.min("node").alias("keep"))
    c = e.withColumn("part", F.expr("parent div 8")).join(first, ["class", "part"]).select("node", "parent", "keep")
    p = c.select(F.col("node").alias("parent"), F.col("keep").alias("up"))
    return c.join(p, "parent", "left").select("node", "keep", F.coalesce("up", "parent").alias("parent"))


@query(" SELECT e.class || '/' || CAST(e.node AS VARCHAR) AS id, p.class || '/' || CAST(p.node AS VARCHAR) AS src FROM edge e LEFT JOIN edge p ON p.node = e.parent", "edge")
def gr01_flatten_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR01, GR04: ids within their namespace, and the edges between them."""
    e = views.edge(spark, sf_dir).withColumn("id", F.concat_ws("/", "class", F.col("node").cast("string")))
    return e.join(e.select(F.col("node").alias("parent"), F.col("id").alias("src")), "parent", "left").select("id", "src")
