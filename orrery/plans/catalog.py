"""All queries: importing this module enters them."""

from orrery.operators import audits, boxes, carries, composed, fidelity, graph, leaks, masks, matching, measures, outlines, poses, regions, relational, reid, release, scalars, series, shapes, signals, silhouettes, spectra, subjects, tracks, warps  # noqa: F401
from orrery.plans.registry import QUERIES, SQL  # noqa: F401
from orrery.sources import bundle, sinks  # noqa: F401

FLAGSHIP = "wn01_rank_of_first_hit"
