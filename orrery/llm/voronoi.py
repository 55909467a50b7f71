"""Operator 8, exact top-k search: a Voronoi join of queries and data by inner product.

Data are grouped by their nearest pivot and, within its cell, by rings around it. For a group the driver knows, of its rows
x with pivot p: the least and greatest length t along p, the greatest length w beside it and the greatest distance r from p.
They bound the inner product of a query with anything in the group: q.x <= max(t q.p/|p|) + |q beside p| w, and
q.x <= q.p + |q| r. Groups next to each other share a unit of bounded size, large ones are dealt out to several. A query first
meets the units of the most promising groups; the k-th score found there rules out the groups whose bound lies below it, and
the query is copied once to each unit that holds another. There a few queries at a time meet the groups that one of them asks.
Vectors without any structure leave all bounds above the k-th score: then every group is asked, and the result stays exact.
A query is no row for each group it asks: rows grow with units, and units with the table no further than UNITS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import discard, keep

#: Rows that pivots are drawn from, least and most pivots (about the root of the rows), rings of a cell, groups asked first,
#: about the rows that a unit holds, units before they hold more, about the queries that meet a unit together, rows or queries
#: whose bounds are taken together, scores held at once.
SAMPLE, PIVOTS, MOST_PIVOTS, RINGS, FIRST, BLOCK, UNITS, PACK, STEP, SCORES = 8192, 128, 1024, 3, 4, 1 << 14, 128, 1 << 16, 256, 1 << 22


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) for each component; null if the vector is null or holds a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Means of a few rounds of clustering a bounded sample, begun from evenly dealt rows."""
    if len(sample) <= n:
        return sample.astype(float)
    centres = sample[:: max(1, len(sample) // n)][:n].astype(float)
    for _ in range(6):
        near = nearest(sample.astype(float), centres)[0]
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(0)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, size = np.zeros(len(rows), np.int64), (centres**2).sum(1)
    for a in range(0, len(rows), STEP):
        at[a : a + STEP] = (size - 2 * rows[a : a + STEP] @ centres.T).argmin(1)
    return at, np.sqrt(((rows - centres[at]) ** 2).sum(1))


def along(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row along its pivot (one pivot a row), and beside it."""
    length = np.sqrt((pivots**2).sum(1))
    t = (rows * pivots).sum(1) / np.where(length > 0, length, 1)
    return t, np.sqrt(np.maximum((rows**2).sum(1) - t**2, 0))


def bounds(q: np.ndarray, centre: np.ndarray, low: np.ndarray, high: np.ndarray, beside: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that each query's inner product with a row of each group can be."""
    toward = q @ centre.T
    length = np.sqrt((centre**2).sum(1))
    t = toward / np.where(length > 0, length, 1)[None, :]
    size = (q**2).sum(1)[:, None]
    first = np.maximum(t * low[None, :], t * high[None, :]) + np.sqrt(np.maximum(size - t**2, 0)) * beside[None, :]
    return np.minimum(first, toward + np.sqrt(size) * radius[None, :])


def stack(vectors: pd.Series, width: int) -> np.ndarray:
    """A matrix of the vectors; a shorter one is filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def kind_of(least: int, most: int) -> str:
    """The smallest type of numbers that holds them."""
    return next((t for t in ("int16", "int32") if np.iinfo(t).min <= least and most <= np.iinfo(t).max), "int64")


def unpacked(vectors: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), width)


def exact(a: np.ndarray, b: np.ndarray) -> type:
    """The numbers in which inner products of these whole numbers are exact and fast: floats of 32 or 64 bits where no sum can
    leave what they hold exactly, else 64-bit integers."""
    most = [max(1.0, -float(x.min(initial=0)), float(x.max(initial=0))) for x in (a, b)]
    largest = most[0] * most[1] * max(1, a.shape[1])
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64


def best(own: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """Scores of each query that are among its k highest over these rows (in order of ids) and no less than its floor; ties go to the
    smaller id, and the query's own row is left out. Vectors are in numbers that are ``exact``."""
    score = q @ x.T
    # a floor that 32 bits do not hold may only be rounded down
    low = (np.nextafter(floor.astype(np.float32), np.float32(-np.inf)) if score.dtype == np.float32 else floor)[:, None]
    hit = score >= low
    if np.count_nonzero(hit) > 8 * (k + 1) * len(q):  # the own row may be among the first k + 1
        edge = np.partition(score, -(k + 1), axis=1)[:, [-(k + 1)]] if score.shape[1] > k + 1 else score.min(1, keepdims=True)
        level = score == edge
        hit &= (score > edge) | level & (np.cumsum(level, axis=1, dtype=np.int32) <= k + 1)
    i, j = np.nonzero(hit)
    fits = ids[j] != own[i]
    i, j = i[fits], j[fits]
    found = score[i, j].astype(np.int64)
    order = np.lexsort((j, ~found, i))
    i, j, found = i[order], j[order], found[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pd.DataFrame({"query_id": own[i[keep]], "vec_id": ids[j[keep]], "score": found[keep]})


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row (those where ``queries``, on vec_id, holds) its k best others: query_id, rank, vec_id, score.

    Fewer than k others give all. Vectors that are null or hold a null or non-finite component, and rows without an id,
    take no part; of rows with one id the smallest vector does; a shorter vector counts as filled with zeros; scores
    beyond 64 bits are undefined. Many equal vectors only fill more blocks: nothing is dropped, capped or sampled. An empty
    table gives an empty one; further columns are ignored.
    """
    return search(vectors, queries, k, id_col, vector_col)[0]


def search(vectors: DataFrame, queries: Column, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """top_k's rows; (query_id, cell) of the groups that are asked after the first ones; groups in all."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("v")).filter("vec_id is not null and v is not null")
    rows = keep(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    known = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    n, width, kind = known[0], max(1, known[1] or 0), kind_of(known[2] or 0, known[3] or 0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    known = stack(sample, width)
    pivots = choose_pivots(known, int(min(MOST_PIVOTS, max(PIVOTS, n**0.5)))) if len(sample) else np.zeros((1, width))
    edges = np.zeros((len(pivots), RINGS - 1))  # of the rings: halves of the rows known, and halves of what is left
    near, far = nearest(known.astype(float), pivots) if len(sample) else (np.zeros(0, int), np.zeros(0))
    for p in np.unique(near):
        edges[p] = np.quantile(far[near == p], 1 - 0.5 ** np.arange(1, RINGS))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = stack(batch["v"], width)
            x = whole.astype(float)
            cell, far = nearest(x, pivots)
            t, w = along(x, pivots[cell])
            ring = (far[:, None] > edges[cell]).sum(1)
            yield batch.assign(v=[r.tobytes() for r in whole.astype(kind)], cell=(cell * RINGS + ring).astype(np.int32), far=far, t=t, w=w)

    data = keep(rows.mapInPandas(assign, "vec_id long, v binary, cell int, far double, t double, w double"))
    discard(rows)
    figures = [F.count("*").alias("n"), F.max("far").alias("radius"), F.min("t").alias("low"), F.max("t").alias("high"), F.max("w").alias("beside")]
    summary = data.groupBy("cell").agg(*figures).toPandas().sort_values("cell")  # MOST_PIVOTS * RINGS rows at most
    cells, count, radius, low, high, beside = (summary[c].to_numpy() for c in ("cell", "n", "radius", "low", "high", "beside"))
    centre = pivots[cells // RINGS] if len(cells) else np.zeros((0, width))
    # groups in a row share a unit of about ``size`` rows; one of more has units of its own
    size = max(BLOCK, -(-n // UNITS))
    first_unit, parts, filled, unit = np.zeros(len(cells), np.int64), np.maximum(1, -(-count // size)).astype(np.int64), 0, -1
    for c, rows_in in enumerate(count.tolist()):
        if unit < 0 or filled + rows_in > size:
            unit, filled = unit + 1, 0
        first_unit[c] = unit
        filled, unit = filled + rows_in, unit + int(parts[c]) - 1
    units = unit + 1
    cell_at = np.repeat(np.arange(len(cells)), parts)  # a place for each group and unit, in order of the units
    unit_at = np.repeat(first_unit, parts) + np.arange(len(cell_at)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.searchsorted(unit_at, np.arange(units))

    asked = data.filter(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    packs = max(1, -(-asked.count() // PACK))
    places = spark.createDataFrame(list(zip(cells.tolist(), first_unit.tolist(), parts.tolist(), strict=True)), "cell int, first_unit long, parts long")
    d = data.join(F.broadcast(places), "cell").withColumn("unit", (F.col("first_unit") + F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("parts"))).cast("int"))
    d = d.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).select("unit", "pack", "vec_id", "v", "cell")

    def asks(q: np.ndarray, floor: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which of some groups may hold what is no less than the floor."""
        bound = bounds(q, centre[some], low[some], high[some], beside[some], radius[some])
        return bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= floor[:, None]

    def solve(wanted: DataFrame) -> DataFrame:
        """The k best of each unit that a row (query_id, q, floor, unit) asks for, over the groups there that may hold any."""
        by = ["unit", "pack"]
        a = wanted.withColumn("pack", F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(packs)).cast("int"))

        def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
            if len(q) and len(x):
                x = x.sort_values("vec_id", kind="stable")
                ids, own, floor = x["vec_id"].to_numpy(), q["query_id"].to_numpy(), q["floor"].to_numpy(float)
                whole, ours = unpacked(x["v"], kind, width), unpacked(q["q"], kind, width)
                numbers = exact(whole, ours)
                whole, ours = whole.astype(numbers), ours.astype(numbers)
                cell = np.searchsorted(cells, x["cell"].to_numpy())
                some, cell = np.unique(cell, return_inverse=True)
                wants = np.concatenate([asks(ours[a : a + STEP].astype(float), floor[a : a + STEP], some) for a in range(0, len(own), STEP)])
                order = np.lexsort(wants.T[:: max(1, -(-wants.shape[1] // 16))])  # queries that ask for the same groups stand together
                step = max(1, SCORES // len(ids))
                for a in range(0, len(order), step):
                    at = order[a : a + step]
                    there = np.flatnonzero(wants[at].any(0)[cell])
                    if len(there):
                        all_there = len(there) == len(ids)
                        out.append(best(own[at], ours[at], floor[at], ids if all_there else ids[there], whole if all_there else whole[there], k))
            return pd.concat(out)

        columns = [*by, "query_id", "q", "floor"]
        return a.select(*columns).groupBy(*by).cogroup(d.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score long")

    def spread(first: bool, by_cell: bool = False):
        """Rows of the units (or groups) that queries ask for: at first those of the most promising groups, then the others that the floor leaves."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for s in range(0, len(whole), STEP):
                    batch = whole.iloc[s : s + STEP]
                    q, floor = unpacked(batch["q"], kind, width).astype(float), batch["floor"].to_numpy(float)
                    home = np.zeros((len(q), len(cells)), bool)
                    np.put_along_axis(home, np.argsort(-(q @ centre.T), axis=1, kind="stable")[:, :FIRST], True, 1)
                    ask = home if first else asks(q, floor, np.arange(len(cells)))
                    if by_cell:
                        i, c = np.nonzero(ask & ~home)
                        yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[i], "cell": cells[c].astype(np.int32)})
                        continue
                    in_units = lambda marks: np.logical_or.reduceat(marks[:, cell_at], starts, axis=1)
                    i, u = np.nonzero(in_units(ask) if first else in_units(ask) & ~in_units(home))
                    yield batch.iloc[i].assign(unit=u.astype(np.int32))

        return run

    row = "query_id long, q binary, floor double, unit int"
    near = keep(solve(asked.withColumn("floor", F.lit(float("-inf"))).mapInPandas(spread(True), row)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floor = near.withColumn("rank", place).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    rest = keep(asked.join(floor, "query_id", "left").fillna(float("-inf"), ["floor"]).select("query_id", "q", "floor"))
    found = near.unionByName(solve(rest.mapInPandas(spread(False), row)))
    out = found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return out, rest.mapInPandas(spread(False, by_cell=True), "query_id long, cell int"), len(cells)
