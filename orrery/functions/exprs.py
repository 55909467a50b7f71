"""Column expressions that operators share. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def quantise(x: Column, low: float, high: float, levels: int) -> Column:
    """The nearest of ``levels`` values from low to high; halves go to the even one."""
    step = (high - low) / (levels - 1)
    return F.bround((x - low) / step) * step + low


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, rounded so that the order of additions cannot decide a tie."""
    return F.round(F.sqrt(squared_distance(a, b)), 9)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def overlap(a: dict[str, Column] | str, b: dict[str, Column] | str) -> Column:
    """Area of the intersection of two boxes given as column prefixes."""
    c = lambda p, k: F.col(f"{p}.{k}")
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: str) -> Column:
    return (F.col(f"{a}.x2") - F.col(f"{a}.x1")) * (F.col(f"{a}.y2") - F.col(f"{a}.y1"))


def iou(a: str, b: str) -> Column:
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that follows from the key alone (first 32 bits of its md5), the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / 4294967296.0
