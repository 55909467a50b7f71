"""Runs and union-find against flooding pixel by pixel, on canvases of any size."""

import numpy as np
import pytest

from orrery.operators.regions import areas, gaps_of, grown, holes, regions, runs_of


def flood(mask, seeds, corners=False):
    seen, todo = set(), [s for s in seeds if mask[s]]
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [q for a, b in steps if 0 <= (q := (p[0] + a, p[1] + b))[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q]]
    return seen


def cells(runs):
    return {(r, x) for r, a, b in runs.tolist() for x in range(a, b + 1)}


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("shape", [(1, 1), (7, 13), (31, 17)])
def test_against_flooding(share, shape):
    rng = np.random.default_rng(int(share * 10) + shape[0])
    for _ in range(6):
        mask = rng.random(shape) < share
        runs = runs_of(*np.nonzero(mask))
        assert cells(runs) == set(zip(*np.nonzero(mask), strict=True)) and cells(gaps_of(runs, *shape)) == set(zip(*np.nonzero(~mask), strict=True))
        edge = [(y, x) for y in range(shape[0]) for x in range(shape[1]) if y in (0, shape[0] - 1) or x in (0, shape[1] - 1)]
        assert cells(holes(runs, *shape)) == set(zip(*np.nonzero(~mask), strict=True)) - flood(~mask, edge)
        for corners in (False, True):
            region = regions(runs, corners)
            want = {frozenset(flood(mask, [p], corners)) for p in zip(*np.nonzero(mask), strict=True)}
            assert {frozenset(cells(runs[region == r])) for r in set(region.tolist())} == want
        assert sorted(areas(runs, regions(runs)).values()) == sorted(len(flood(mask, [tuple(runs[k, :2])])) for k in set(regions(runs).tolist()))
        marker = mask & (rng.random(shape) < 0.1)
        assert cells(grown(runs_of(*np.nonzero(marker)), runs)) == flood(mask, list(zip(*np.nonzero(marker), strict=True)))
