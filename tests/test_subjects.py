"""The subject lock: its laws, a plain loop over the whole table, and stream against batch."""

import random

from orrery.operators.subjects import SubjectLock, locked, people_of, st06_subject_lock
from orrery.streaming.live import lock_subjects


def test_laws():
    lock = SubjectLock(window=4, min_share=0.25, min_frames=3)
    for _ in range(3):
        assert lock.step([(1, 100.0), (2, 10.0)]) == {1: True, 2: True}
    assert lock.step([(1, 90.0), (3, 400.0)])[3]  # one frame only: not enough
    assert lock.step([(1, 5.0), (2, 500.0), (3, 9.0)]) == {1: True, 2: False, 3: False}  # 10 and 400 are decided at the close
    assert lock.step([]) == {} and lock.opened == 0
    assert lock.step([(2, 7.0), (3, 9.0)]) == {2: False, 3: True} and lock.opened == 1  # nobody enrolled is left: the largest
    assert lock.step([(1, 1.0), (2, 99.0), (3, 1.0)]) == {1: True, 2: False, 3: True}
    short = SubjectLock(window=1)
    short.step([(8, 5.0), (7, 5.0)])
    assert short.step([(7, 1.0), (8, 9.0)]) == {7: True, 8: False}  # none often enough: the largest, ties to the smaller
    assert SubjectLock(window=2).resume(short.state()).step([(9, 1.0)]) == {9: True}


def slow(rows, window=15, share=0.25, least=3):
    out = []
    for clip in sorted({r[0] for r in rows}):
        frames = {}
        for _, f, t, a in (r for r in rows if r[0] == clip):
            frames.setdefault(f, []).append((t, max(0.0, a)))
        order = sorted(frames)
        first, area, times = order[:window], {}, {}
        for f in first:
            for t in {t for t, _ in frames[f]}:
                area[t] = max(area.get(t, 0.0), *(a for u, a in frames[f] if u == t))
                times[t] = times.get(t, 0) + 1
            out += [(clip, f, t, True) for t, _ in frames[f]]
        chosen = {t for t in area if area[t] >= share * max(area.values()) and times[t] >= least} or {min(area, key=lambda t: (-area[t], t))}
        for f in order[window:]:
            here = {t for t, _ in frames[f]}
            if not here & chosen:
                chosen.add(min(frames[f], key=lambda x: (-x[1], x[0]))[0])
            out += [(clip, f, t, t in chosen) for t, _ in frames[f]]
    return sorted(out)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in people_of(spark, sf_dir).collect()]
    got = sorted((r.clip, r.frame, r.track, r.kept) for r in st06_subject_lock(spark, sf_dir).collect())
    assert got == slow(rows) and {r[3] for r in got} == {True, False}


def test_stream_is_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(c, f, t, float(rnd.randrange(-3, 40))) for c in range(3) for f in range(40) for t in range(6) if rnd.random() < 0.3]
    kind = "clip long, frame long, track long, area double"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = lock_subjects(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), window=7).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    want = locked(spark.createDataFrame(rows, kind), window=7)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect())) and want.filter("opened > 0").count()


def test_empty_and_null(spark):
    kind = "clip long, frame long, track long, area double"
    assert locked(spark.createDataFrame([], kind)).count() == 0
    rows = locked(spark.createDataFrame([(1, 1, None, 2.0), (1, 1, 5, None), (None, 1, 5, 1.0), (1, 2, 5, 1.0), (1, 2, 5, 1.0)], kind)).collect()
    assert len(rows) == 3 and all(r.kept for r in rows)
