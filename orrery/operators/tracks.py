"""Trackers: order-dependent assignment of people to slots, in batch (a clip is a group) and as a stream (a clip is state)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.clips import walk
from orrery.plans.registry import query
from orrery.sources import views

#: Farthest move from one frame to the next, and frames that an absent person's slot stays reserved.
GATE, GRACE = 60.0, 2
#: Frames that a new order of lanes must last, the part of the frame's width beyond which it holds at once, and that width.
HOLD, MARGIN, WIDTH = 4, 0.04, 640.0


def nearest_first(xs: list[float], places: dict[int, float], gate: float) -> dict[int, int]:
    """JN10: detections by place, one to one, nearest pairs first, none further apart than ``gate``."""
    taken: dict[int, int] = {}
    seen: set[int] = set()
    for gap, place, d in sorted((abs(x - at), place, d) for d, x in enumerate(xs) for place, at in places.items()):
        if gap <= gate and place not in taken and d not in seen:
            taken[place] = d
            seen.add(d)
    return taken


class SlotTracker:
    """ST01, ST03: nearest pairs first, one to one, within the gate; a new person takes the lowest free slot."""

    def __init__(self, state: dict[int, tuple[float, int]] | None = None):
        self.state = dict(state or {})

    def step(self, frame: int, xs: list[float]) -> list[int]:
        self.state = {s: (x, f) for s, (x, f) in self.state.items() if frame - f <= GRACE + 1}
        taken = nearest_first(xs, {s: x for s, (x, _) in self.state.items()}, GATE)
        slot = {d: s for s, d in taken.items()}
        free = (s for s in count() if s not in self.state)
        for d in sorted(range(len(xs)), key=lambda d: (xs[d], d)):
            if d not in slot:
                slot[d] = next(free)
        self.state |= {slot[d]: (x, frame) for d, x in enumerate(xs)}
        return [slot[d] for d in range(len(xs))]


class LaneTracker:
    """ST02, WN09: lanes from left to right. People keep their lanes while they cross, until the new order lasts or is plain."""

    def __init__(self):
        self.lanes: list[float] = []
        self.sought, self.seen = (), 0

    def step(self, xs: list[float]) -> list[int]:
        """The lane of each detection. Another number of people than before starts anew, in the order of x."""
        if len(xs) != len(self.lanes):
            who = sorted(range(len(xs)), key=lambda d: (xs[d], d))
            self.sought, self.seen = (), 0
        else:
            taken = nearest_first(xs, dict(enumerate(self.lanes)), float("inf"))
            who = [taken[lane] for lane in range(len(xs))]
            who = self.settle(who, [xs[d] for d in who])
        self.lanes = [xs[d] for d in who]
        lane = {d: k for k, d in enumerate(who)}
        return [lane[d] for d in range(len(xs))]

    def settle(self, who: list[int], at: list[float]) -> list[int]:
        """``who`` put in the order of x if that order has been sought HOLD times running, or a neighbour is far on the wrong side."""
        order = tuple(sorted(range(len(at)), key=lambda k: (at[k], k)))
        self.seen = self.seen + 1 if order == self.sought else 1
        self.sought = order
        wrong = max((a - b for a, b in zip(at, at[1:])), default=0.0)
        if wrong <= 0 or wrong <= MARGIN * WIDTH and self.seen < HOLD:
            if wrong <= 0:
                self.sought, self.seen = (), 0
            return who
        self.sought, self.seen = (), 0
        return [who[k] for k in order]


def slots_of() -> Callable[[list[tuple]], list[tuple]]:
    """Called with the rows (clip, frame, det, x) of one frame after another of a clip."""
    tracker = SlotTracker()

    def step(rows: list[tuple]) -> list[tuple]:
        return [(*r[:3], slot, r[3]) for r, slot in zip(rows, tracker.step(rows[0][1], [r[3] for r in rows]), strict=True)]

    return step


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of detections: a run of 1,024 order keys is a clip, so clips grow in number with the table and not in length."""
    return views.box(spark, sf_dir).selectExpr("frame div 1024 AS clip", "frame % 1024 AS frame", "det", "(x1 + x2) / 2 AS x")


def slots(rows: DataFrame) -> DataFrame:
    """(clip, frame, det, slot, x) of rows (clip, frame, det, x). A clip's frames come in order; a task holds one frame and the tracker's state."""
    return walk(rows.select("clip", "frame", "det", "x"), "clip", ["frame", "det"], ["frame"], slots_of, "clip long, frame long, det long, slot long, x double")


@query()
def st01_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST01, ST03, JN10: slots of every detection of every clip, in the order of frames."""
    return slots(detections(spark, sf_dir)).drop("x")


def lanes_of() -> Callable[[list[tuple]], list[tuple]]:
    tracker = LaneTracker()
    return lambda rows: [(*r[:3], lane) for r, lane in zip(rows, tracker.step([r[3] for r in rows]), strict=True)]


@query()
def st02_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST02, WN09: the lane of every detection of every clip, with hysteresis and a reset where people come or go."""
    rows = detections(spark, sf_dir).select("clip", "frame", "det", "x")
    return walk(rows, "clip", ["frame", "det"], ["frame"], lanes_of, "clip long, frame long, det long, lane long")


@query()
def ag39_identity_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG39: how often the slots of the leftmost and of the rightmost person change in a clip. Held against a plain loop in the tests."""
    ends = slots(detections(spark, sf_dir)).groupBy("clip", "frame").agg(F.min_by("slot", F.struct("x", "det")).alias("left"), F.max_by("slot", F.struct("x", "det")).alias("right"))
    per = W.partitionBy("clip").orderBy("frame")
    changed = [F.count_if(F.col(f"{c}_changed")).alias(f"{c}_switches") for c in ("left", "right")]
    for c in ("left", "right"):
        ends = ends.withColumn(f"{c}_changed", F.col(c) != F.lag(c).over(per))
    return ends.groupBy("clip").agg(*changed)
