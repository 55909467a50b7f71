"""All pairs of vectors, block by block: both sides are dealt to blocks of bounded size, every two blocks meet in a task of their own.

Squared distances of a block come from one matrix product. They decide alone where the answer cannot hang on their rounding; pairs
nearer to a threshold than SLACK allows are measured again as ``exprs.distance`` does (additions in order, nine places). So results are
those of comparing each pair exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a block on the left and on the right, and left rows whose distances are held at once.
LEFT, RIGHT, AT_ONCE = 4096, 16384, 256
#: Error allowed to squared distances, by 1 + the squared norms: beyond rounding to nine places, and beyond that of the product alone.
SLACK, PRODUCT = 1e-8, 1e-12


class Side(NamedTuple):
    """Columns of a block by name, its vectors and their squared norms."""

    cols: dict[str, np.ndarray]
    x: np.ndarray
    sq: np.ndarray

    def __getitem__(self, name: str) -> np.ndarray:
        return self.cols[name]

    def part(self, at) -> Side:
        return Side({k: v[at] for k, v in self.cols.items()}, self.x[at], self.sq[at])


def vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def side(table, vector: str) -> Side:
    x = vectors(table.column(vector))
    return Side({c: table.column(c).to_numpy() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c).to_numpy(zero_copy_only=False) for c in table.schema.names if c != vector}, x, (x * x).sum(1))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows, one to one, added in the order of the components."""
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += (x[:, j] - y[:, j]) ** 2
    return np.round(np.sqrt(s), 9)


def slices(p: Side, g: Side, differ: tuple[str, ...]) -> Iterator[tuple[Side, np.ndarray, np.ndarray]]:
    """(part of p, squared distances to g, 1 + squared norms of each row); distances are infinite where a column of ``differ`` is the same."""
    if not len(g.sq):
        return
    for at in range(0, len(p.sq), AT_ONCE):
        q = p.part(slice(at, at + AT_ONCE))
        d2 = q.x @ g.x.T
        d2 *= -2
        d2 += q.sq[:, None]
        d2 += g.sq[None]
        for c in differ:
            np.putmask(d2, q[c][:, None] == g[c][None], np.inf)
        yield q, d2, 1 + q.sq + g.sq.max()


def closer(q: Side, g: Side, d2: np.ndarray, scale: np.ndarray, d: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Whether each of g comes before the row's target by (distance, name): d and ours are the target's, theirs the names in g."""
    t, room = d * d, SLACK * scale
    first = d2 < (t - room)[:, None]
    i, j = np.nonzero((d2 <= (t + room)[:, None]) & ~first)
    for k in range(0, len(i), 1 << 18):
        a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
        e = exact(q.x[a], g.x[b])
        first[a, b] = (e < d[a]) | ((e == d[a]) & (theirs[b] < ours[a]))
    return first


def smallest(q: Side, g: Side, d2: np.ndarray, scale: np.ndarray, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of g, distance): the k smallest of each row by (distance, name)."""
    edge = (d2.min(1) if k == 1 else np.partition(d2, k - 1, axis=1)[:, k - 1]) if k <= d2.shape[1] else np.full(len(d2), np.inf)
    i, j = np.nonzero((d2 <= (edge + SLACK * scale)[:, None]) & (d2 < np.inf))
    e = np.concatenate([exact(q.x[i[s : s + (1 << 18)]], g.x[j[s : s + (1 << 18)]]) for s in range(0, len(i), 1 << 18)] or [np.zeros(0)])
    order = np.lexsort((names[j], e, i))
    i, j, e = i[order], j[order], e[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], e[place < k]


def steps(q: Side, g: Side, d2: np.ndarray, scale: np.ndarray, low: float, high: float, n: int) -> np.ndarray:
    """For each pair the first k of 0 to n - 1 with distance <= low + (high - low) * k / (n - 1), n where there is none; n + 1 where barred."""
    edges = low + (high - low) * np.arange(n) / (n - 1.0)
    unit = (n - 1.0) / (high - low) if high > low else 0.0
    barred = d2 == np.inf
    d2 = np.where(barred, 0.0, np.maximum(d2, 0.0))
    at = (np.sqrt(d2) - low) * unit
    # below a thousandth of the scale a root is too uncertain; above, it errs by this at most
    whole = scale.max()
    error = 2e-9 * (1 + np.sqrt(whole)) * unit + 1e-9
    out = np.clip(np.ceil(at), 0, n).astype(np.int32)
    i, j = np.nonzero(((np.abs(at - np.rint(at)) <= error) & (at > -1) & (at < n) | (d2 < 1e-6 * whole)) & ~barred)
    for k in range(0, len(i), 1 << 18):
        a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
        out[a, b] = np.searchsorted(edges, exact(q.x[a], g.x[b]), "left")
    out[barred] = n + 1
    return out


def meet(left: DataFrame, right: DataFrame, ids: tuple[str, str], each: Callable[[Side, Side], Iterator[dict]], schema: str, on: tuple[str, ...] = ()) -> DataFrame:
    """What ``each`` makes of two blocks, over all blocks of rows that agree in ``on``. Vectors are in columns ``pv`` and ``gv``; rows without one take no part."""
    left, right = left.filter("pv IS NOT NULL AND NOT exists(pv, x -> x IS NULL)"), right.filter("gv IS NOT NULL AND NOT exists(gv, x -> x IS NULL)")
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    ln, rn = left.groupBy(*on).agg(F.count("*").alias("ln")), right.groupBy(*on).agg(F.count("*").alias("rn"))
    sizes = (ln.join(rn, list(on)) if on else ln.crossJoin(rn)).select(*on, blocks("ln", LEFT).alias("ls"), blocks("rn", RIGHT).alias("rs")).filter("ls > 0 AND rs > 0")
    if on:
        l, r = left.join(sizes, list(on)), right.join(sizes, list(on))
    else:
        l, r = left.crossJoin(F.broadcast(sizes)), right.crossJoin(F.broadcast(sizes))  # one row
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    l = l.withColumn("lb", own(ids[0], "ls")).withColumn("rb", every("rs")).drop("ls", "rs")
    r = r.withColumn("rb", own(ids[1], "rs")).withColumn("lb", every("ls")).drop("ls", "rs")
    return cogrouped(l, r, (*on, "lb", "rb"), each, schema)


def cogrouped(left: DataFrame, right: DataFrame, by: tuple[str, ...], each: Callable[[Side, Side], Iterator[dict]], schema: str) -> DataFrame:
    """``each`` of the blocks of both sides that share ``by``; a block without a partner makes nothing."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(p: pa.Table, g: pa.Table) -> pa.Table:
        made = list(each(side(p, "pv"), side(g, "gv"))) if p.num_rows and g.num_rows else []
        return pa.concat_tables([out.empty_table(), *(pa.table(t, schema=out) for t in made)])

    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may be of one table
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)
