"""The composed pass over a log of poses: skeletons rebuilt to one build, re-timed, smoothed, moved and held near what was seen.

A run is a stretch of frames in which one person keeps a slot. Spark finds runs, their sizes and their clocks; a task then takes
the frames of runs, in order, through a chain of stages: those of many short runs at once, as arrays; those of a long one by one. A
stage keeps what it carries from frame to frame and the few samples that it still reads; a frame waits in it until the samples ahead
of it that it needs have come. So a task holds some frames of a long run, however long it is. What depends on medians of the result (fit of the width) and all that stays within
a frame (head, nearness, attached joints, canvas) are column expressions after the walk.

Joints are numbered as in whole-body logs of 133: 0 to 16 body, 17 to 22 feet, 23 to 90 face, 91 to 132 hands.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.tables import keep
from orrery.operators.warps import clock, smooth_noise
from orrery.plans.registry import query
from orrery.sources import views

#: Child, parent, group of each bone, parents first; 17 is the middle of the hips, 18 that of the shoulders.
BONES = [
    (18, 17, "spine"), (11, 17, "hip"), (12, 17, "hip"), (13, 11, "thigh"), (15, 13, "shin"), (14, 12, "thigh"), (16, 14, "shin"),
    (5, 18, "clav"), (6, 18, "clav"), (0, 18, "neck"), (7, 5, "uarm"), (9, 7, "farm"), (8, 6, "uarm"), (10, 8, "farm"),
    (1, 0, "face"), (3, 1, "face"), (2, 0, "face"), (4, 2, "face"),
]
#: Length of each group's bone, as a part of the width of the shoulders.
BUILD = {"clav": 0.5, "neck": 0.6, "uarm": 0.795, "farm": 0.624, "spine": 1.231, "hip": 0.36, "thigh": 1.047, "shin": 1.051, "face": 0.13}
GROUPS = sorted(BUILD)
LIMBS = ("thigh", "shin", "uarm", "farm")
#: Anchor and joints of each limb; joints that move with an anchor's joint (first, last, anchor).
CHAINS = [(5, (7, 9)), (6, (8, 10)), (11, (13, 15)), (12, (14, 16))]
ATTACHED = [(17, 19, 15), (20, 22, 16), (91, 111, 9), (112, 132, 10)]
#: A joint is seen from this confidence on; runs of fewer frames are left as they are; a bone shorter than this cannot be scaled.
SEEN, FLOOR, THIN = 0.5, 5, 1e-3
CANVAS = (640.0, 480.0)
#: What a frame's slow noise keeps from the frame before, and frames on each side that are smoothed over.
KEPT, AROUND = 0.9, 3
#: Runs of more frames are walked frame by frame.
LONG = 1024
KEY = ["clip", "slot", "run"]
RUN = ["arm", *KEY]


@dataclass(frozen=True)
class Arm:
    """Strengths of the stages; nought leaves a stage out. Angles in degrees, times in frames, parts of the figure's height."""

    name: str
    rebuild: bool = True
    angle: float = 4.0
    drift: float = 2.0
    sway: float = 0.01
    cadence: bool = True
    phase: float = 1.5
    sigma: float = 1.0
    path: float = 1.5
    period: float = 24.0
    part: float = 0.05
    swing: float = 0.2
    fit: bool = True
    head: bool = True
    cap: float = 0.25


SHIPPED = Arm("shipped")
#: The build alone; the build with times; all stages.
ARMS = (Arm("build", angle=0, drift=0, sway=0, cadence=False, phase=0, sigma=0, path=0, swing=0, fit=False, head=False, cap=0), Arm("times", angle=0, drift=0, sway=0, swing=0, fit=False, cap=0), SHIPPED)


class Frame(NamedTuple):
    """i: place in the run; t: where the run's clock reads; at: 17 places, not a number where unseen; raw: those before."""

    i: int
    frame: int
    t: float
    at: np.ndarray
    raw: np.ndarray


def draw(seed: str, *key: object) -> float:
    """A number in [0, 1) that follows from seed and key."""
    return int(md5("|".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16) / 2**32


def noise(seed: str, i: int, size: int) -> np.ndarray:
    return np.random.default_rng([int(md5(seed.encode()).hexdigest()[:8], 16), i]).standard_normal(size)


def root(at: np.ndarray) -> np.ndarray:
    return (at[..., 11, :] + at[..., 12, :]) / 2


def turned(v: np.ndarray, angle: float | np.ndarray) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([v[..., 0] * c - v[..., 1] * s, v[..., 0] * s + v[..., 1] * c], -1)


class Rebuilt:
    """Each bone scaled to the build and turned, from the hips on; slow noise of angles and places is carried along."""

    def __init__(self, arm: Arm, seed: str, factors: dict[str, float], tall: float):
        self.factors, self.tall, self.arm, self.seed = factors, tall, arm, seed
        still = noise(seed, -1 % 2**31, len(GROUPS))
        self.still = {g: np.deg2rad(arm.angle) * still[k] if g in LIMBS else 0.0 for k, g in enumerate(GROUPS)}
        self.slow = np.zeros(len(GROUPS) + 34)

    def push(self, f: Frame) -> list[Frame]:
        self.slow = KEPT * self.slow + np.sqrt(1 - KEPT * KEPT) * noise(self.seed, f.i, len(self.slow))
        turn = {g: self.still[g] + (np.deg2rad(self.arm.drift) * self.slow[k] if g in LIMBS else 0.0) for k, g in enumerate(GROUPS)}
        old = np.vstack([f.at, root(f.at), (f.at[5] + f.at[6]) / 2])
        new = np.full((19, 2), np.nan)
        new[17] = old[17]
        for child, parent, g in BONES:
            new[child] = new[parent] + self.factors[g] * turned(old[child] - old[parent], turn[g])
        return [f._replace(at=new[:17] + self.arm.sway * self.tall * self.slow[len(GROUPS) :].reshape(17, 2))]


class Reading:
    """A frame waits until the last sample it is read from has come; samples that no later frame reads are let go."""

    def __init__(self, n: int):
        self.n, self.held, self.waiting = n, {}, deque()

    def low(self, f: Frame) -> float: ...
    def high(self, f: Frame) -> float: ...
    def made(self, f: Frame) -> np.ndarray: ...

    def push(self, f: Frame) -> list[Frame]:
        self.held[f.i] = f.at
        self.waiting.append(f)
        out = []
        while self.waiting and min(np.ceil(self.high(self.waiting[0])), self.n - 1) <= f.i:
            first = self.waiting.popleft()
            out.append(first._replace(at=self.made(first)))
            keep = min(self.low(first), first.i)
            while next(iter(self.held)) < np.floor(keep):
                del self.held[next(iter(self.held))]
        return out

    def at(self, t: float, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        t = min(max(t, 0.0), self.n - 1.0)
        k = int(t)
        return of(self.held[k]) if t == k else (1 - (t - k)) * of(self.held[k]) + (t - k) * of(self.held[k + 1])


class Cadence(Reading):
    """The figure about its hips is read along the run's clock; the hips stay."""

    def low(self, f: Frame) -> float:
        return f.t

    high = low

    def made(self, f: Frame) -> np.ndarray:
        return self.at(f.t, lambda a: a - root(a)) + root(f.at)


class Phase(Reading):
    """Each limb is read at a time of its own, about its anchor."""

    def __init__(self, n: int, most: float, seed: str):
        super().__init__(n)
        self.most = most
        self.shift = [most * (2 * draw(seed, "phase", c) - 1) for c in range(len(CHAINS))]

    def low(self, f: Frame) -> float:
        return f.i - self.most

    def high(self, f: Frame) -> float:
        return f.i + self.most

    def made(self, f: Frame) -> np.ndarray:
        new = f.at.copy()
        for shift, (anchor, joints) in zip(self.shift, CHAINS, strict=True):
            new[list(joints)] = f.at[anchor] + self.at(f.i + shift, lambda a, anchor=anchor, joints=joints: a[list(joints)] - a[anchor])
        return new


class Smooth(Reading):
    """The figure about its hips is averaged over the samples around, those that are seen; unseen joints stay unseen."""

    def __init__(self, n: int, sigma: float):
        super().__init__(n)
        self.weight = np.exp(-0.5 * (np.arange(-AROUND, AROUND + 1) / sigma) ** 2)

    def low(self, f: Frame) -> float:
        return f.i - AROUND + 1

    def high(self, f: Frame) -> float:
        return f.i + AROUND

    def made(self, f: Frame) -> np.ndarray:
        places = range(max(0, f.i - AROUND), min(self.n - 1, f.i + AROUND) + 1)
        all_ = np.stack([self.held[k] - root(self.held[k]) for k in places])
        w = np.where(np.isnan(all_), 0.0, self.weight[[k - f.i + AROUND for k in places], None, None])
        with np.errstate(invalid="ignore"):
            mean = (w * np.nan_to_num(all_)).sum(0) / w.sum(0)
        return np.where(np.isnan(f.at), np.nan, mean + root(f.at))


class Path(Reading):
    """The hips are read along a swaying clock and the figure goes with them, a part of its height at most."""

    def __init__(self, n: int, arm: Arm, seed: str, tall: float):
        super().__init__(n)
        self.arm, self.cap, self.start = arm, arm.part * tall, 2 * np.pi * draw(seed, "path")

    def low(self, f: Frame) -> float:
        return f.i - self.arm.path

    def high(self, f: Frame) -> float:
        return f.i + self.arm.path

    def made(self, f: Frame) -> np.ndarray:
        d = self.at(f.i + self.arm.path * np.sin(2 * np.pi * f.i / self.arm.period + self.start), root) - root(f.at)
        far = np.hypot(*d)
        return f.at if np.isnan(far) else f.at + d * (min(1.0, self.cap / far) if far else 1.0)


class Swing:
    """Each limb's turn away from its mean direction so far is scaled; the sums of directions are carried along."""

    def __init__(self, most: float, seed: str):
        self.scale = [most * (2 * draw(seed, "swing", c) - 1) for c in range(len(CHAINS))]
        self.sums = np.zeros((len(CHAINS), 2))

    def push(self, f: Frame) -> list[Frame]:
        new = f.at.copy()
        for c, (anchor, joints) in enumerate(CHAINS):
            d = f.at[joints[0]] - f.at[anchor]
            if np.isnan(d).any() or not d.any():
                continue
            self.sums[c] += d / np.hypot(*d)
            away = np.arctan2(d[1], d[0]) - np.arctan2(self.sums[c][1], self.sums[c][0])
            away = (away + np.pi) % (2 * np.pi) - np.pi
            for j in joints:
                new[j] = f.at[anchor] + turned(f.at[j] - f.at[anchor], self.scale[c] * away)
        return [f._replace(at=new)]


def chain(arm: Arm, seed: str, n: int, factors: dict[str, float], tall: float) -> list:
    """The stages of an arm in their order."""
    stages = [Rebuilt(arm, seed, factors, tall)] if arm.rebuild else []
    stages += [Cadence(n)] if arm.cadence else []
    stages += [Phase(n, arm.phase, seed)] if arm.phase else []
    stages += [Smooth(n, arm.sigma)] if arm.sigma else []
    stages += [Path(n, arm, seed, tall)] if arm.path else []
    return stages + ([Swing(arm.swing, seed)] if arm.swing else [])


def through(stages: list, f: Frame) -> list[Frame]:
    frames = [f]
    for s in stages:
        frames = [made for g in frames for made in s.push(g)]
    return frames


WALKED = "arm string, clip long, slot long, run long, frame long, rx array<double>, ry array<double>, mx array<double>, my array<double>"


class Runs:
    """The frames of some whole runs, one run after the other; what the stages do to a frame is done to all of them at once.

    i, n: place in the run and its length; run: number of the run; its first frame stands at i places before each.
    """

    def __init__(self, seeds: list[str], i: np.ndarray, n: np.ndarray, t: np.ndarray, tall: np.ndarray, factors: np.ndarray, raw: np.ndarray):
        self.seeds, self.i, self.n, self.t, self.tall, self.factors, self.raw = seeds, i, n, t, tall, factors, raw
        self.run, self.start, self.z = np.cumsum(i == 0) - 1, np.arange(len(i)) - i, None

    def of_run(self, f: Callable[[str], float]) -> np.ndarray:
        """A number that follows from a run's seed, at each of its frames."""
        return np.array([f(s) for s in self.seeds])[self.run]

    def carried(self, step: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """step(here, before) for the first frames of all runs, for their second ones, and so on; first frames stand before themselves."""
        order = np.argsort(self.i, kind="stable")
        for here in np.split(order, np.cumsum(np.bincount(self.i))[:-1]):
            step(here, here - (self.i[here] > 0))

    def at(self, t: np.ndarray, of: np.ndarray) -> np.ndarray:
        t = np.clip(t, 0.0, self.n - 1.0)
        k = np.floor(t).astype(np.int64)
        f = (t - k).reshape(-1, *[1] * (of.ndim - 1))
        low, high = of[self.start + k], of[self.start + np.minimum(k + 1, self.n - 1)]
        return np.where(f == 0, low, (1 - f) * low + f * high)

    def rebuilt(self, arm: Arm, at: np.ndarray) -> np.ndarray:
        size = len(GROUPS) + 34
        if self.z is None:  # all arms have the same
            first = [int(md5(s.encode()).hexdigest()[:8], 16) for s in self.seeds]
            self.z = np.stack([np.random.default_rng([first[r], i]).standard_normal(size) for r, i in zip(self.run.tolist(), self.i.tolist(), strict=True)])
        still = np.stack([noise(s, -1 % 2**31, len(GROUPS)) for s in self.seeds])[self.run]
        slow = np.sqrt(1 - KEPT * KEPT) * self.z

        def step(here: np.ndarray, before: np.ndarray) -> None:
            if self.i[here[0]]:
                slow[here] += KEPT * slow[before]

        self.carried(step)
        old = np.concatenate([at, root(at)[:, None], ((at[:, 5] + at[:, 6]) / 2)[:, None]], axis=1)
        new = np.full_like(old, np.nan)
        new[:, 17] = old[:, 17]
        for child, parent, g in BONES:
            k, v = GROUPS.index(g), old[:, child] - old[:, parent]
            if g in LIMBS:
                v = turned(v, np.deg2rad(arm.angle) * still[:, k] + np.deg2rad(arm.drift) * slow[:, k])
            new[:, child] = new[:, parent] + self.factors[:, k, None] * v
        return new[:, :17] + (arm.sway * self.tall)[:, None, None] * slow[:, len(GROUPS) :].reshape(-1, 17, 2)

    def phased(self, arm: Arm, at: np.ndarray) -> np.ndarray:
        new = at.copy()
        for c, (anchor, joints) in enumerate(CHAINS):
            shift = self.of_run(lambda s, c=c: arm.phase * (2 * draw(s, "phase", c) - 1))
            new[:, list(joints)] = at[:, [anchor]] + self.at(self.i + shift, at[:, list(joints)] - at[:, [anchor]])
        return new

    def smoothed(self, arm: Arm, at: np.ndarray) -> np.ndarray:
        hips = root(at)[:, None]
        rel, total, weights = at - hips, np.zeros_like(at), np.zeros_like(at)
        for step in range(-AROUND, AROUND + 1):
            here = np.flatnonzero((self.i + step >= 0) & (self.i + step < self.n))
            other = rel[here + step]
            w = np.where(np.isnan(other), 0.0, np.exp(-0.5 * (step / arm.sigma) ** 2))
            total[here] += w * np.nan_to_num(other)
            weights[here] += w
        with np.errstate(invalid="ignore"):
            return np.where(np.isnan(at), np.nan, total / weights + hips)

    def along_path(self, arm: Arm, at: np.ndarray) -> np.ndarray:
        start = self.of_run(lambda s: 2 * np.pi * draw(s, "path"))
        d = self.at(self.i + arm.path * np.sin(2 * np.pi * self.i / arm.period + start), root(at)) - root(at)
        far = np.hypot(d[:, 0], d[:, 1])
        with np.errstate(invalid="ignore", divide="ignore"):
            part = np.where(far > 0, np.minimum(1.0, arm.part * self.tall / far), 1.0)
        return np.where(np.isnan(far)[:, None, None], at, at + (d * part[:, None])[:, None])

    def swung(self, arm: Arm, at: np.ndarray) -> np.ndarray:
        new = at.copy()
        for c, (anchor, joints) in enumerate(CHAINS):
            scale = self.of_run(lambda s, c=c: arm.swing * (2 * draw(s, "swing", c) - 1))
            d = at[:, joints[0]] - at[:, anchor]
            good = ~np.isnan(d).any(1) & d.any(1)
            sums = np.zeros_like(d)
            sums[good] = d[good] / np.hypot(d[good, 0], d[good, 1])[:, None]

            def step(here: np.ndarray, before: np.ndarray, sums: np.ndarray = sums) -> None:
                if self.i[here[0]]:
                    sums[here] += sums[before]

            self.carried(step)
            away = np.arctan2(d[:, 1], d[:, 0]) - np.arctan2(sums[:, 1], sums[:, 0])
            away = (away + np.pi) % (2 * np.pi) - np.pi
            for j in joints:
                moved = at[:, anchor] + turned(at[:, j] - at[:, anchor], scale * away)
                new[:, j] = np.where(good[:, None], moved, at[:, j])
        return new

    def made(self, arm: Arm) -> np.ndarray:
        """All frames after the stages of an arm, in the order of ``chain``."""
        at = self.raw
        at = self.rebuilt(arm, at) if arm.rebuild else at
        at = self.at(self.t, at - root(at)[:, None]) + root(at)[:, None] if arm.cadence else at
        at = self.phased(arm, at) if arm.phase else at
        at = self.smoothed(arm, at) if arm.sigma else at
        at = self.along_path(arm, at) if arm.path else at
        return self.swung(arm, at) if arm.swing else at


def walker(arms: tuple[Arm, ...], salt: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows (KEY, frame, i, n, t, tall, factors, xs, ys) sorted by KEY and frame: all arms of each run.

    Runs of up to LONG frames are made whole, many together; longer ones frame by frame, so that a task holds a few of their frames.
    """

    def out(arm: Arm, key: np.ndarray, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(0, 17 * len(key) + 1, 17, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a[:, :, k]).ravel())) for a in (raw, at) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([arm.name] * len(key), pa.string()), *map(pa.array, key.T), *lists], names=[c.split()[0] for c in WALKED.split(", ")])

    def seed(key: np.ndarray) -> str:
        return "|".join(map(str, (salt, *key[:3].tolist())))

    def together(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        key, i, n, t, tall, factors, raw = rows
        some = Runs([seed(k) for k in key[i == 0]], i, n, t, tall, factors, raw)
        for arm in arms:
            yield out(arm, key, raw, some.made(arm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, stages = None, {}
        for batch in batches:
            flat = lambda c, w, batch=batch: batch[c].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, w)
            one = lambda c, batch=batch: batch[c].to_numpy(zero_copy_only=False)
            rows = (np.stack([one(c) for c in (*KEY, "frame")], 1), one("i").astype(np.int64), one("n"), one("t"), one("tall"), flat("factors", len(GROUPS)), np.stack([flat("xs", 17), flat("ys", 17)], 2))
            long = np.flatnonzero(rows[2] > LONG)
            for arm in arms if len(long) else ():
                frames, keys = [], []
                for r in long.tolist():
                    key, i, n, t, tall, factors, raw = (c[r] for c in rows)
                    if i == 0:
                        stages[arm.name] = chain(arm, seed(key), int(n), dict(zip(GROUPS, factors.tolist(), strict=True)), float(tall))
                    made = through(stages[arm.name], Frame(int(i), int(key[3]), float(t), raw, raw))
                    frames += made
                    keys += [(*key[:3].tolist(), f.frame) for f in made]
                if frames:
                    yield out(arm, np.array(keys, np.int64), np.stack([f.raw for f in frames]), np.stack([f.at for f in frames]))
            short = rows[2] <= LONG
            rows = tuple(c[short] for c in rows)
            rows = rows if waiting is None else tuple(np.concatenate(c) for c in zip(waiting, rows, strict=True))
            ends = np.flatnonzero(rows[1] == rows[2] - 1)
            end = ends[-1] + 1 if len(ends) else 0
            waiting = tuple(c[end:] for c in rows)
            if end:
                yield from together(tuple(c[:end] for c in rows))

    return run


def seen_runs(log: DataFrame) -> DataFrame:
    """(clip, slot, frame, ident, xs, ys, run, i, n) of frames with a body joint that is seen; a new person in a slot (null is one) starts a run."""
    seen = log.filter(f"joint between 0 and 16 and conf >= {SEEN} and x is not null and y is not null and not isnan(x) and not isnan(y)")
    m = F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y"))))
    rows = seen.groupBy("clip", "slot", "frame", "joint").agg(F.max(F.struct("conf", "x", "y", "ident")).alias("b"))
    rows = rows.select("clip", "slot", "frame", "joint", "b.x", "b.y", "b.ident").groupBy("clip", "slot", "frame").agg(m.alias("m"), F.max("ident").alias("ident"))
    along = W.partitionBy("clip", "slot").orderBy("frame")
    new = (~F.col("ident").eqNullSafe(F.lag("ident").over(along)) | F.lag("frame").over(along).isNull()).cast("long")
    rows = rows.withColumn("run", F.sum(new).over(along))
    run = W.partitionBy("clip", "slot", "run")
    rows = rows.withColumn("i", F.row_number().over(run.orderBy("frame")) - 1).withColumn("n", F.count("*").over(run))
    axis = lambda v: F.expr(f"transform(sequence(0, 16), j -> m[cast(j AS int)].{v})")
    return rows.select("clip", "slot", "run", "frame", "ident", "i", "n", axis("x").alias("xs"), axis("y").alias("ys"))


def within(z: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least pass over nulls)."""
    return F.when(z.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), z)))


def _length(c: int, p: int) -> Column:
    def place(j: int, v: str) -> Column:
        if j < 17:
            return F.col(v)[j]
        a, b = (11, 12) if j == 17 else (5, 6)
        return (F.col(v)[a] + F.col(v)[b]) / 2

    return F.hypot(place(c, "xs") - place(p, "xs"), place(c, "ys") - place(p, "ys"))


def sizes(runs: DataFrame) -> DataFrame:
    """Of each run: n, tall (median height), factors (by group, to the build) and status: done, short or degenerate."""
    per = runs.select("clip", "slot", "run", "n", "xs", "ys", (F.array_max("ys") - F.array_min("ys")).alias("h"))
    bones = {g: [_length(c, p) for c, p, k in BONES if k == g] for g in GROUPS}
    key = ["clip", "slot", "run"]
    most = max(map(len, bones.values()))  # a row holds one bone of every group
    each = [F.struct(*[(lengths[k] if k < len(lengths) else F.lit(None).cast("double")).alias(g) for g, lengths in bones.items()]) for k in range(most)]
    median = per.select(*key, F.explode(F.array(*each)).alias("b")).groupBy(*key).agg(*[F.median(f"b.{g}").alias(g) for g in GROUPS])
    tall = per.groupBy(*key).agg(F.first("n").alias("n"), F.greatest(F.median("h"), F.lit(1.0)).alias("tall"))
    s = tall.join(median, key, "left")
    stature = BUILD["neck"] + BUILD["spine"] + BUILD["thigh"] + BUILD["shin"]
    width = F.coalesce(2 * F.col("clav"), F.col("spine") / BUILD["spine"], F.col("tall") / stature)
    factors = F.array(*[F.coalesce(width * BUILD[g] / F.col(g), F.lit(1.0)) for g in GROUPS])
    thin = F.least(*[F.coalesce(F.col(g), F.lit(1.0)) for g in GROUPS]) < THIN
    status = F.when(F.col("n") < FLOOR, "short").when(thin, "degenerate").otherwise("done")
    return s.select(*key, "n", "tall", F.when(~thin, factors).alias("factors"), status.alias("status"))


def walked(log: DataFrame, arms: tuple[Arm, ...], salt: str) -> tuple[DataFrame, DataFrame]:
    """Frames of runs that are done (written, as runs and sizes are: all are read more than once), before (rx, ry) and after the chain (mx, my), and all frames that have a run with its status."""
    runs = keep(seen_runs(log))
    size = keep(sizes(runs))
    done = runs.join(size.filter("status = 'done'").drop("n"), KEY)
    timed = clock(smooth_noise(done, KEY, F.lit(salt), *map(F.col, KEY)), KEY)
    rows = timed.select(*KEY, "frame", "i", "n", "t", "tall", "factors", "xs", "ys")
    frames = keep(rows.repartition(*KEY).sortWithinPartitions(*KEY, "frame").mapInArrow(walker(arms, salt), WALKED))
    return frames.join(size.select("clip", "slot", "run", "tall"), ["clip", "slot", "run"]), runs.select("clip", "slot", "run", "frame").join(size, ["clip", "slot", "run"])


def fitted(frames: DataFrame, arms: tuple[Arm, ...], canvas: tuple[float, float] | None) -> DataFrame:
    """The width fitted to that seen, the head put where the nose was, each joint held near, all within the canvas."""
    for v in ("mx", "my", "rx", "ry"):
        frames = frames.withColumn(v, F.transform(v, lambda z: F.when(~F.isnan(z), z)))
    named = lambda k: F.create_map(*[F.lit(z) for a in arms for z in (a.name, getattr(a, k))])[F.col("arm")]
    wide = lambda v: F.median(F.abs(F.col(v)[5] - F.col(v)[6]))
    s = frames.groupBy(*RUN).agg((wide("rx") / F.nullif(wide("mx"), F.lit(0.0))).alias("sx"))
    s = s.select(*RUN, F.when(named("fit"), F.coalesce(within(F.col("sx"), 0.5, 2.0), F.lit(1.0))).otherwise(1.0).alias("sx"))
    f = frames.join(s, RUN).withColumn("hips", (F.col("mx")[11] + F.col("mx")[12]) / 2)
    f = f.withColumn("mx", F.transform("mx", lambda z: F.when(F.col("sx") == 1.0, z).otherwise(F.col("hips") + F.col("sx") * (z - F.col("hips")))))
    for m, r in (("mx", "rx"), ("my", "ry")):
        off = F.when(named("head"), F.coalesce(F.col(r)[0] - F.col(m)[0], F.lit(0.0))).otherwise(0.0)
        f = f.withColumn("off", off).withColumn(m, F.transform(m, lambda z, j: F.when(j < 5, z + F.col("off")).otherwise(z)))
    cap = named("cap") * F.col("tall")
    far = F.zip_with(F.zip_with("mx", "rx", lambda a, b: a - b), F.zip_with("my", "ry", lambda a, b: a - b), F.hypot)
    f = f.withColumn("cap", cap).withColumn("far", far).withColumn("held", F.transform("far", lambda d: (F.col("cap") > 0) & (d > F.col("cap"))))
    for k, (m, r) in enumerate((("mx", "rx"), ("my", "ry"))):
        at = F.transform(m, lambda z, j: F.when(F.get("held", j), F.get(r, j) + (z - F.get(r, j)) * F.col("cap") / F.get("far", j)).otherwise(z))  # noqa: B023
        f = f.withColumn(m, at).withColumn(f"d{m}", F.transform(m, lambda z, j: z - F.get(r, j)))  # noqa: B023
        if canvas:
            edge = canvas[k]
            f = f.withColumn(m, F.transform(m, lambda z: within(z, 0.0, edge)))  # noqa: B023
    return f.select(*RUN, "frame", "mx", "my", "dmx", "dmy", "held")


def composed(log: DataFrame, arms: tuple[Arm, ...] = (SHIPPED,), salt: str = "", canvas: tuple[float, float] | None = CANVAS, unfit: str = "keep") -> DataFrame:
    """(arm, clip, slot, run, frame, joint, x, y, conf, status, held) of rows log (clip, slot, frame, ident, joint, x, y, conf).

    PO12 to PO15. Body joints that are seen come from the chain; feet and hands move with their ankle or wrist and go where that
    is unseen; face and unseen joints go; places are clipped to the canvas and rounded to two digits; conf becomes 0 or 1. A
    joint that hangs on one that was never seen in its frame cannot be rebuilt and goes. Rows of frames without a body joint
    (status absent) and of runs that are too short or degenerate pass as they are; ``unfit="drop"`` lets those go and
    "raise" stops at them. Null or NaN places count as unseen; of repeated joints the most confident (then largest) stays; an empty
    table gives none. ``salt`` is drawn anew for a release (``secrets.token_hex()``) and stays one for the whole job, so that a
    lost task is made again alike.
    """
    log = log.select("clip", "slot", "frame", "ident", "joint", "x", "y", "conf")
    frames, states = walked(log, arms, salt)
    rows = log.groupBy("clip", "slot", "frame", "joint").agg(F.max(F.struct("conf", "x", "y")).alias("b")).select("clip", "slot", "frame", "joint", "b.*")
    rows = rows.join(states.select("clip", "slot", "frame", "run", "status"), ["clip", "slot", "frame"], "left").withColumn("status", F.coalesce("status", F.lit("absent")))
    rows = keep(rows)  # read by both branches below
    conf = F.when(F.col("conf") >= SEEN, 1).otherwise(0).alias("conf")
    known = (F.col("conf") >= SEEN) & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")

    anchor = F.when(F.col("joint") < 17, F.col("joint"))
    for first, last, a in ATTACHED:
        anchor = anchor.when(F.col("joint").between(first, last), a)
    mine = rows.filter("status = 'done'").withColumn("anchor", anchor.otherwise(-1)).filter("anchor >= 0 and not (joint < 17 and conf < 0.5)")
    out = mine.join(fitted(frames, arms, canvas), ["clip", "slot", "run", "frame"])
    x, y = (F.when(F.col("joint") < 17, F.get(m, "anchor")).otherwise(F.col(v) + F.get(f"d{m}", "anchor")) for v, m in (("x", "mx"), ("y", "my")))
    if canvas:
        x, y = (within(z, 0.0, e) for z, e in ((x, canvas[0]), (y, canvas[1])))
    names = ["arm", "clip", "slot", "run", "frame", "joint"]
    out = out.filter(known).select(*names, F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), conf, "status", F.coalesce(F.get("held", "anchor"), F.lit(False)).alias("held"))
    out = out.filter("x is not null and y is not null")
    rest = rows.filter("status <> 'done'")
    if unfit == "raise":
        rest = rest.withColumn("status", F.when(F.col("status") == "degenerate", F.raise_error(F.lit("a run's bones are degenerate"))).otherwise(F.col("status")))
    elif unfit == "drop":
        rest = rest.filter("status = 'absent'")
    rest = rest.withColumn("arm", F.explode(F.array(*[F.lit(a.name) for a in arms])))
    return out.unionByName(rest.select(*names, F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), conf, "status", F.lit(False).alias("held")))


def whole_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose log on ``lineitem``: a slot has the frames of 2,048 order keys, a person keeps it for 20 frames; two of three rows are body joints."""
    t = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 4096 AS clip", "l_orderkey div 2048 % 2 AS slot", "l_orderkey % 64 AS frame", "l_orderkey % 64 div 20 AS ident",
        "cast(CASE WHEN l_partkey % 3 < 2 THEN l_partkey % 17 ELSE 17 + l_partkey % 116 END AS int) AS joint",
        "cast(l_partkey % 600 AS double) AS x", "cast((l_suppkey * 37) % 300 AS double) AS y", "1 - cast(l_tax AS double) * 10 AS conf",
    )
    return t.groupBy("clip", "slot", "frame", "ident", "joint").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("conf").alias("conf"))


@query()
def po13_pose_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO12, PO13, PO18: every joint of every clip after the composed pass. Held against plain NumPy over whole runs in the tests."""
    return composed(whole_log(spark, sf_dir)).drop("arm")


@query()
def po14_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO14: of each run its state and how many frames and joints came out, were held near or lie on the edge of the canvas."""
    edge = F.col("x").isin(0.0, CANVAS[0]) | F.col("y").isin(0.0, CANVAS[1])
    return composed(whole_log(spark, sf_dir)).groupBy("clip", "slot", "run", "status").agg(
        F.countDistinct("frame").alias("n_frames"), F.count("*").alias("n_joints"), F.count_if("held").alias("n_held"), F.count_if(edge).alias("n_edge")
    )


@query()
def po15_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PO15, TS15: the body joints of three arms (the build alone, with times, all stages) against those seen: how many, and how far off on average."""
    log = whole_log(spark, sf_dir).filter("joint < 17")
    made = composed(log, ARMS, canvas=None).filter("status = 'done'").alias("m").join(log.alias("l"), ["clip", "slot", "frame", "joint"])
    off = F.hypot(F.col("m.x") - F.col("l.x"), F.col("m.y") - F.col("l.y"))
    return made.groupBy("arm", "clip").agg(F.count("*").alias("n"), F.round(F.avg(off), 3).alias("off"))
