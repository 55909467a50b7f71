"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import keep

#: Edges that a task looks at together.
CHUNK = 1 << 18


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of these edges to the smallest node that it reaches over them."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = number[: len(a)], number[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    k = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[k], nodes[root[k]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) that join the same nodes: those that lie in one chunk of a partition become stars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
            a, b = star_edges(*(np.concatenate([x[c].to_numpy(np.int64) for x in held]) for c in "ab"))
            return pd.DataFrame({"a": a, "b": b})

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CHUNK:
                yield stars(held)
                held, size = [], 0
        if size:
            yield stars(held)

    return edges.mapInPandas(run, "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Every larger end has one edge and is the smaller end of none: each component is a star around its smallest node."""
    ends = edges.selectExpr("a AS u", "1 AS up", "0 AS down").union(edges.selectExpr("b AS u", "0 AS up", "1 AS down"))
    per = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.agg(F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, component) for each node of ``edges`` (a long, b long): component is its smallest reachable node.

    Loops and repeated edges are harmless; an empty table gives none. Each step aggregates a minimum for a node (combined
    before the shuffle), writes it and joins it back. A hub's edges meet in that join only: row by row, never as one group,
    and the adaptive plan deals a large hub out to several tasks, since both sides come from tables. What ends the loop is one row:
    whether all are stars, so no step is spent on edges that are stars already. Edges that lie in one partition become stars at
    once, chunk by chunk, which saves most steps.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = keep(_contracted(e).distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = keep(least)
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.distinct())
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = keep(_contracted(small.filter("a <> b").distinct()).distinct())
    # stars now: every node but the smallest points at the smallest
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
