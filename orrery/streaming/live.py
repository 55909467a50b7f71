"""The same questions over unbounded input: windows with a watermark, sessions, and trackers whose state Spark keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.operators.subjects import OUT, SubjectLock, frame_of
from orrery.operators.tracks import SlotTracker


def windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind; events later than ``late`` behind the newest are dropped by the watermark."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST05: presence runs: a session ends when nothing came for ``gap``."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def track(detections: DataFrame) -> DataFrame:
    """ST01 as a stream of (clip, frame, det, x): state is each slot's last place; frames come in order within a clip."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [])
        tracker = SlotTracker({int(s): (float(x), int(f)) for s, x, f in zip(*held, strict=True)})
        rows = pd.concat(list(batches)).sort_values(["frame", "det"])
        for frame, part in rows.groupby("frame", sort=True):
            yield part.assign(slot=tracker.step(int(frame), part.x.tolist()))[["clip", "frame", "det", "slot"]]
        slots = list(tracker.state)
        state.update((slots, [tracker.state[s][0] for s in slots], [tracker.state[s][1] for s in slots]))

    kind = "slots array<long>, xs array<double>, frames array<long>"
    return detections.groupBy("clip").applyInPandasWithState(step, "clip long, frame long, det long, slot long", kind, "append", GroupStateTimeout.NoTimeout)


def lock_subjects(people: DataFrame, **parameters: float) -> DataFrame:
    """ST06 as a stream of (clip, frame, track, area): the state is that of ``subjects.SubjectLock``; frames come whole and in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lock = SubjectLock(**parameters)
        if state.exists:
            lock.resume(dict(zip(lock.state(), state.get, strict=True)))
        rows = pd.concat(list(batches)).sort_values(["frame", "track", "area"])
        for _, part in rows.groupby("frame", sort=True):
            found = frame_of(lock, list(part[["clip", "frame", "track", "area"]].itertuples(index=False, name=None)))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in OUT.split(", ")])
        state.update(tuple(lock.state().values()))

    kind = "frames long, opened long, closed boolean, enrolled array<long>, tracks array<long>, areas array<double>, times array<long>"
    return people.groupBy("clip").applyInPandasWithState(step, OUT, kind, "append", GroupStateTimeout.NoTimeout)
