"""Neighbours of probes in a gallery, without comparing every probe with every gallery row.

Gallery rows are dealt to the nearest of a few pivots; each group keeps its size and the least and largest distance to its pivot, by view.
By the triangle inequality a group lies wholly within a probe's radius (it is counted in bulk), wholly beyond it (it is left
out), or may cross it. Groups are packed into units of bounded size (a larger group is cut into several); a probe is joined with the
units that hold a crossed group and compared there by ``blocks``. Distances are Euclidean, rounded as ``exprs.distance`` does; bounds
leave SLACK for that. A gallery without structure crosses everywhere: then all pairs are compared, block by block, never as a nested
loop, and a probe is sent once to each unit and not to each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.tables import keep
from orrery.operators import blocks
from orrery.operators.blocks import Side

#: Pivots at most, what bounds leave to rounding, and probes whose bounds are held at once.
PIVOTS, SLACK, AT_ONCE = 256, 1e-6, 256


class Gallery(NamedTuple):
    """Written members (gallery, found, view, gv, g), pivots, and by group and view: rows, least and largest distance to the pivot."""

    members: DataFrame
    pivots: np.ndarray
    views: dict[object, int]
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance of each vector to the rows of each (group, view); infinite where there are none."""
        d = far(matrix(vectors), self.pivots)[:, :, None]
        lower = np.maximum(0, np.maximum(d - self.high[None], self.low[None] - d)) - SLACK
        return np.where(self.n[None] > 0, lower, np.inf), np.where(self.n[None] > 0, d + self.high[None] + SLACK, np.inf)


def matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, np.stack([((x - p) ** 2).sum(1) for p in y], axis=1))) if len(y) else np.zeros((len(x), 0))


def grouped(gallery: DataFrame, pivots: int | None = None) -> Gallery:
    """gallery: (gallery, found, view, gv). A table of groups by views comes to the driver: views are those of a rig, so few.

    Rows without a vector, or with nulls in it, take no part. Pivots are the rows whose ids hash lowest; any choice gives right answers.
    """
    gallery = gallery.filter("gv IS NOT NULL AND NOT exists(gv, x -> x IS NULL)")
    k = pivots or int(min(PIVOTS, max(1, np.sqrt(gallery.count()))))
    found = [r[0] for r in gallery.orderBy(F.xxhash64("gallery"), "gallery").select("gv").limit(k).collect()]
    centres = matrix(found)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = far(matrix(batch["gv"].tolist()), centres)
                yield batch.assign(g=d.argmin(1).astype(np.int32), to=d.min(1))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gallery.schema)
    members = keep(gallery.mapInPandas(assign, f"{kinds}, g int, to double"))
    rows = members.groupBy("g", "view").agg(F.count("*").alias("n"), F.min("to").alias("low"), F.max("to").alias("high")).collect()
    views = {v: i for i, v in enumerate(sorted({r.view for r in rows}))}
    shape = (len(centres), len(views))
    n, low, high = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
    for r in rows:
        at = r.g, views[r.view]
        n[at], low[at], high[at] = r.n, r.low, r.high
    return Gallery(members.drop("to"), centres, views, n, low, high)


class Units(NamedTuple):
    """Groups packed in order: the first group of each unit, the blocks that it is cut into, and the number of its first block."""

    first: np.ndarray
    cut: np.ndarray
    base: np.ndarray


def units(g: Gallery) -> Units:
    first, size, held = [], [], 0
    for i, n in enumerate(g.n.sum(1)):
        if not first or held + n > blocks.RIGHT:
            first.append(i)
            size.append(0)
            held = 0
        held += int(n)
        size[-1] = held
    cut = np.maximum(1, -(-np.array(size, int) // blocks.RIGHT))
    return Units(np.array(first, int), cut, np.cumsum(cut) - cut)


def asked(probes: DataFrame, g: Gallery, u: Units, crossed, schema: str) -> DataFrame:
    """``probes`` once for each block of each unit that ``crossed`` names, as ``gb``; it may add a row without a block, with ``bulk``.

    crossed: (bounds of the gallery, columns of the probes) -> (whether each probe asks each unit, bulk or None).
    """
    codes, bare = {v: i for v, i in g.views.items()}, g._replace(members=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                lower, upper = bare.bounds(blocks.vectors(batch.column("pv")))
                own = np.array([codes.get(v, -1) for v in batch.column("view").to_pylist()])
                other = own[:, None] != np.arange(len(codes))[None]
                wants, bulk = crossed(lower, upper, other, batch)
                row, unit = np.nonzero(wants)
                row, unit = np.repeat(row, u.cut[unit]), np.repeat(unit, u.cut[unit])
                block = u.base[unit] + np.arange(len(unit)) - np.searchsorted(row * len(u.cut) + unit, row * len(u.cut) + unit)
                sent = batch.take(pa.array(row)).append_column("gb", pa.array(block.astype(np.int32)))
                yield sent.append_column("bulk", pa.array(np.zeros(len(row), np.int64)))
                if bulk is not None:
                    yield batch.append_column("gb", pa.nulls(batch.num_rows, pa.int32())).append_column("bulk", pa.array(bulk))

    return keep(probes.filter("pv IS NOT NULL AND NOT exists(pv, x -> x IS NULL)").mapInArrow(run, schema + ", gb int, bulk long"))


def met(asks: DataFrame, gallery: Gallery, u: Units, each, schema: str) -> DataFrame:
    """``each`` of blocks of probes and the gallery blocks that they ask for."""
    asks = asks.filter("gb IS NOT NULL").drop("bulk")
    parts = max(1, -(-asks.count() // (max(1, int(u.cut.sum())) * blocks.LEFT)))
    unit_of = np.searchsorted(u.first, np.arange(len(gallery.pivots)), "right") - 1
    of = lambda a: F.lit([int(x) for x in a] or [0])[F.col("g")]
    members = gallery.members.withColumn("gb", (of(u.base[unit_of]) + F.pmod(F.xxhash64("gallery"), of(u.cut[unit_of]))).cast("int"))
    members = members.drop("g").withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asks = asks.withColumn("pb", F.pmod(F.xxhash64("probe"), F.lit(parts)).cast("int"))
    return blocks.cogrouped(asks, members, ("gb", "pb"), each, schema)


def ranks(targets: DataFrame, gallery: Gallery) -> DataFrame:
    """(probe, gallery, rank): the rank of each target among the gallery rows of other views, by (distance, gallery).

    targets: (probe, view, pv, gallery, d), d the distance of the gallery row from the probe; a probe may have several, on one row each.
    """
    g, u = gallery._replace(members=None), units(gallery)

    def crossed(lower, upper, other, batch):
        d = batch.column("d").to_numpy()[:, None, None]
        there = other[:, None, :] & (g.n > 0)[None]
        inside = there & (upper < d)
        crosses = there & ~inside & (lower <= d)
        if not len(u.first):
            return np.zeros((len(d), 0), bool), np.zeros(len(d), np.int64)
        wants = np.logical_or.reduceat(crosses.any(2), u.first, axis=1)
        # what is compared row by row is not counted in bulk
        whole = np.add.reduceat((inside * g.n[None]).sum(2), u.first, axis=1)
        return wants, np.where(wants, 0, whole).sum(1)

    def each(p: Side, g: Side) -> Iterator[dict]:
        for q, d2, scale in blocks.slices(p, g, ("view",)):
            n = blocks.closer(q, g, d2, scale, q["d"], q["gallery"], g["gallery"]).sum(1)
            yield {"probe": q["probe"], "gallery": q["gallery"], "n": n.astype(np.int64)}

    targets = targets.select("probe", F.col("view").cast("int").alias("view"), "pv", "gallery", "d")
    asks = asked(targets, gallery, u, crossed, "probe long, view int, pv array<double>, gallery long, d double")
    bulk = asks.filter("gb IS NULL").select("probe", "gallery", F.col("bulk").alias("n"))
    near = met(asks, gallery, u, each, "probe long, gallery long, n long")
    return bulk.unionByName(near).groupBy("probe", "gallery").agg((F.sum("n") + 1).alias("rank"))


def nearest(probes: DataFrame, gallery: Gallery, k: int = 1, each_view: bool = False) -> DataFrame:
    """(probe, gallery, found, gallery_view, d, r): the ``k`` nearest gallery rows of other views, by (distance, gallery); ``each_view``: of each of them.

    probes: (probe, view, pv). The radius that surely holds k rows follows from the groups' bounds; groups beyond it are not joined.
    """
    g, u = gallery._replace(members=None), units(gallery)

    def radius(upper: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(upper, axis=1, kind="stable")
        enough = np.cumsum(np.take_along_axis(n, order, 1), axis=1) >= k
        found = np.take_along_axis(np.take_along_axis(upper, order, 1), enough.argmax(1)[:, None], 1)[:, 0]
        return np.where(enough.any(1), found, np.inf)

    def crossed(lower, upper, other, batch):
        there = other[:, None, :] & (g.n > 0)[None]
        if not len(u.first):
            return np.zeros((len(other), 0), bool), None
        n, up = np.where(there, g.n[None], 0), np.where(there, upper, np.inf)
        if each_view:
            reach = np.stack([radius(up[:, :, v], n[:, :, v]) for v in range(n.shape[2])], axis=1)[:, None, :]
        else:
            reach = radius(up.reshape(len(up), -1), n.reshape(len(n), -1))[:, None, None]
        return np.logical_or.reduceat((there & (lower <= reach)).any(2), u.first, axis=1), None

    def each(p: Side, g: Side) -> Iterator[dict]:
        for v in np.unique(g["view"]) if each_view else [None]:
            part = g if v is None else g.part(g["view"] == v)
            for q, d2, scale in blocks.slices(p, part, ("view",)):
                i, j, d = blocks.smallest(q, part, d2, scale, k, part["gallery"])
                yield {"probe": q["probe"][i], "gallery": part["gallery"][j], "found": part["found"][j], "gallery_view": part["view"][j], "d": d}

    probes = probes.select("probe", F.col("view").cast("int").alias("view"), "pv")
    asks = asked(probes, gallery, u, crossed, "probe long, view int, pv array<double>")
    found = gallery.members.schema["found"].dataType.simpleString()
    rows = met(asks, gallery, u, each, f"probe long, gallery long, found {found}, gallery_view int, d double")
    by = W.partitionBy("probe", *(["gallery_view"] if each_view else [])).orderBy("d", "gallery")
    return rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k)  # each task keeps k rows of a probe before the shuffle


def nearest_own(probes: DataFrame, gallery: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """(probe, gallery, d): the nearest gallery row that agrees with the probe in ``on`` and differs from it in all other columns that both
    have, by (distance, gallery). probes: (probe, pv, ...), gallery: (gallery, gv, ...)."""
    differ = tuple(c for c in probes.columns if c in gallery.columns and c not in on)

    def each(p: Side, g: Side) -> Iterator[dict]:
        for q, d2, scale in blocks.slices(p, g, differ):
            i, j, d = blocks.smallest(q, g, d2, scale, 1, g["gallery"])
            yield {"probe": q["probe"][i], "gallery": g["gallery"][j], "d": d}

    rows = blocks.meet(probes, gallery, ("probe", "gallery"), each, "probe long, gallery long, d double", on)
    return rows.groupBy("probe").agg(F.min(F.struct("d", "gallery")).alias("m")).select("probe", "m.gallery", "m.d")
