import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import voronoi


def slow(rows, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(256 * y) for y in v]
            whole[i] = min(whole.get(i, x), x)
    out = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], x, strict=False)), i) for i, x in whole.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 2048])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(voronoi, "BLOCK", block)
    monkeypatch.setattr(voronoi, "PIVOTS", 12)
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = [(i, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)]) for i in range(600)]
    rows += [(i, [0.5] * 8) for i in range(600, 900)]  # one vector of a third of the rows
    rows += [(1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [9.0] * 8), (1200, [2.0, 1.0]), (1200, [3.0]), (1250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cell", F.lit("x"))
    got = voronoi.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == slow(rows)


def test_few_rows(spark):
    for n in (0, 1, 3):
        rows = [(50 * i, [1.0 * i, 2.0]) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, voronoi.top_k(df, F.col("vec_id") % 50 == 0).collect())) == slow(rows)


def share_asked(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, more, groups = voronoi.search(df, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding")
    assert sorted(map(tuple, out.collect())) == slow(rows)
    return more.count() / (groups * len([1 for i, _ in rows if i % 50 == 0]))


def test_groups_are_ruled_out(spark):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [c + rnd.gauss(0, 0.05) for c in rnd.choice(centres)]) for i in range(2000)]
    assert share_asked(spark, rows) < 0.2
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(1000)]  # nothing to rule groups out by
    assert share_asked(spark, rows) <= 1


def test_rows_do_not_grow_with_groups(spark, monkeypatch):
    """Vectors without structure: every query asks nearly every group, which is no row of any table that is written."""
    written = []
    monkeypatch.setattr(voronoi, "keep", lambda df, keep=voronoi.keep: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(voronoi, "discard", lambda *tables: None, raising=False)
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, more, groups = voronoi.search(df, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding")
    assert sorted(map(tuple, out.collect())) == slow(rows)
    assert more.count() > 20 * groups / 2 > 2000  # what each query asks
    assert max(t.count() for t in written) <= len(rows)


def test_scores_of_many_units_and_sizes_of_numbers(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 20)
    monkeypatch.setattr(voronoi, "PACK", 3)
    monkeypatch.setattr(voronoi, "SCORES", 60)
    rnd = random.Random(7)
    for scale in (1, 300, 3 * 10**6):  # sums in floats of 32 and 64 bits, and in integers
        rows = [(i, [float(rnd.randint(-3, 3)) * scale / 2 for _ in range(4)]) for i in range(400)]  # many ties
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, voronoi.top_k(df, F.col("vec_id") % 50 == 0).collect())) == slow(rows)
