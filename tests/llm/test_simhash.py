import random

import numpy as np
import xxhash
from cases import AWKWARD, awkward, empty
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.components import components


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = slow_components([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_whole(spark, monkeypatch):
    """Random clusters, dense and sparse, against all pairs; blocks small enough that groups are dealt out."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(3)
    fps = set()
    for _ in range(40):
        centre = rnd.getrandbits(64)
        bits = rnd.sample(range(64), 12)
        for _ in range(rnd.choice((1, 5, 60))):
            fps.add(centre ^ sum(1 << b for b in rnd.sample(bits, rnd.randint(0, 6))))
    fps = np.array(sorted(fps), np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    signed = fps.view(np.int64).tolist()
    want = slow_components([(signed[a], signed[b]) for a, b in near])
    got = components(simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"), 3))
    assert {r.node: r.component for r in got.collect()} == want


def test_thresholds_obey_the_pigeonhole_sum():
    rnd = np.random.default_rng(1)
    fps = rnd.integers(0, 1 << 63, 500, dtype=np.uint64)
    for m in (2, 3, 4):
        groups = simhash.group_bits(fps, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        t, _ = simhash.allocate(fps, fps[:100], groups, 3, 10**6)
        assert ((t + 1).sum(1) == 4).all()


def test_documents(spark):
    rows = simhash.near_duplicates(awkward(spark)).withColumn("hex", simhash.hexadecimal(F.col("fp"))).collect()
    assert len(rows) == len(AWKWARD)
    want = sorted((str(i), f"{slow_fingerprint(t):016x}") for i, t, *_ in AWKWARD)
    assert sorted((str(r.doc_id), r.hex) for r in rows) == want
    of = {r.doc_id: r.component_id for r in rows}
    assert of[2] == of[3] == of[4] == 2 and of[1] == of[9] == 1 and of[None] is None
    assert simhash.near_duplicates(empty(spark)).count() == 0
