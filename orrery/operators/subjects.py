"""Subject lock: who is enrolled in a clip is decided once, when a window of frames closes, and opened again only on total loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.functions.clips import walk
from orrery.plans.registry import query
from orrery.sources import views

#: Frames of the window, the share of the largest candidate's area and the frames that a candidate needs.
WINDOW, MIN_SHARE, MIN_FRAMES = 15, 0.25, 3
COLUMNS = ["clip", "frame", "track", "area"]
OUT = "clip long, frame long, track long, kept boolean, enrolled int, opened int"


class SubjectLock:
    """The state of one clip; ``step`` takes a frame's (track, area) and says who stays.

    While the window is open all stay, and candidates gather their largest area and their frames. At its close those stay that
    come near the largest and were seen often enough; if none does, the largest alone (ties: the smaller track). Later tracks
    are refused, but where a frame has people and none of them is enrolled, the largest of them is enrolled too.
    """

    def __init__(self, window: int = WINDOW, min_share: float = MIN_SHARE, min_frames: int = MIN_FRAMES) -> None:
        self.window, self.min_share, self.min_frames = window, min_share, min_frames
        self.frames, self.opened = 0, 0
        self.seen: dict[int, tuple[float, int]] = {}
        self.enrolled: set[int] | None = None  # None: the window is open

    def state(self) -> dict:
        """What a stream keeps of it: numbers and lists."""
        tracks = sorted(self.seen)
        return {
            "frames": self.frames, "opened": self.opened, "closed": self.enrolled is not None, "enrolled": sorted(self.enrolled or ()),
            "tracks": tracks, "areas": [self.seen[t][0] for t in tracks], "times": [self.seen[t][1] for t in tracks],
        }

    def resume(self, state: dict) -> SubjectLock:
        self.frames, self.opened = int(state["frames"]), int(state["opened"])
        self.seen = {int(t): (float(a), int(n)) for t, a, n in zip(state["tracks"], state["areas"], state["times"], strict=True)}
        self.enrolled = {int(t) for t in state["enrolled"]} if state["closed"] else None
        return self

    def close(self) -> None:
        most = max((a for a, _ in self.seen.values()), default=0.0)
        chosen = {t for t, (a, n) in self.seen.items() if a >= self.min_share * most and n >= self.min_frames}
        self.enrolled = chosen or ({min(self.seen, key=lambda t: (-self.seen[t][0], t))} if self.seen else set())
        self.seen = {}

    def step(self, people: list[tuple[int, float]]) -> dict[int, bool]:
        """Whether each track of the frame is kept. Several boxes of one track count as its largest."""
        areas: dict[int, float] = {}
        for track, area in people:
            areas[track] = max(area, areas.get(track, 0.0))
        self.frames += 1
        if self.frames <= self.window:
            for t, a in areas.items():
                before, n = self.seen.get(t, (0.0, 0))
                self.seen[t] = max(before, a), n + 1
            return dict.fromkeys(areas, True)
        if self.enrolled is None:
            self.close()
        if areas and not self.enrolled & set(areas):
            self.enrolled.add(min(areas, key=lambda t: (-areas[t], t)))
            self.opened += 1
        return {t: t in self.enrolled for t in areas}


def lock_of(make: Callable[[], SubjectLock] = SubjectLock) -> Callable[[], Callable[[list[tuple]], list[tuple]]]:
    """A function for each clip that takes the rows (COLUMNS) of a frame."""

    def start() -> Callable[[list[tuple]], list[tuple]]:
        lock = make()
        return lambda rows: frame_of(lock, rows)

    return start


def frame_of(lock: SubjectLock, rows: list[tuple]) -> list[tuple]:
    kept = lock.step([(int(t), max(0.0, float(a))) for *_, t, a in rows])
    size = len(lock.enrolled) if lock.enrolled is not None else len(lock.seen)
    return [(clip, frame, track, kept[int(track)], size, lock.opened) for clip, frame, track, _ in rows]


def locked(people: DataFrame, **parameters: float) -> DataFrame:
    """(clip, frame, track, kept, enrolled, opened) for each row of people (clip, frame, track, area), frame by frame within a clip.

    enrolled: how many are (candidates, while the window is open); opened: enrolments on loss so far. Frames without people do
    not count; null tracks and areas are left out; repeated rows give a row each; an empty table gives none. A task holds one frame and the
    state of its clip.
    """
    rows = people.select(*COLUMNS).filter("track IS NOT NULL AND area IS NOT NULL")
    return walk(rows, "clip", ["frame", "track", "area"], ["frame"], lock_of(lambda: SubjectLock(**parameters)), OUT)


def people_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as people: a clip is a run of 1,024 order keys; tracks take new numbers every 128 of them, as after a loss."""
    return views.box(spark, sf_dir).selectExpr("frame div 1024 AS clip", "frame % 1024 AS frame", "det + (frame div 128) % 3 AS track", "(x2 - x1) * (y2 - y1) AS area")


@query()
def st06_subject_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST06: every person of every clip, kept or refused, with enrolment by window and on loss. Held against a plain loop in the tests."""
    return locked(people_of(spark, sf_dir))
