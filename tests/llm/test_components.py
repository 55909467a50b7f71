import random

import pytest

from orrery.llm import components as c


def by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return root, find


@pytest.mark.parametrize("kind, steps", [("empty", 0), ("stars", 0), ("chain", None), ("random", None)])
def test_steps_are_taken_only_until_all_are_stars(spark, monkeypatch, kind, steps):
    rnd = random.Random(6)
    edges = {
        "empty": [],
        "stars": [(1, 9), (5, 1), (1, 5), (7, 7), (-3, 4)],
        "chain": [(k, k + 1) for k in range(40)],
        "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)],
    }[kind]
    written = []
    monkeypatch.setattr(c, "keep", lambda df, keep=c.keep: written.append(keep(df)) or written[-1])
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    root, find = by_hand(real)
    assert got == {x: find(x) for x in root}
    assert steps is None or len(written) == 1 + 4 * steps
