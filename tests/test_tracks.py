"""Laws of the order-dependent operators, and the stream against the batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import audits, boxes, masks, release, tracks
from orrery.operators.release import parse_packet
from orrery.streaming import live


def test_slots_are_one_to_one_and_follow_people():
    t = tracks.SlotTracker()
    assert t.step(0, [10.0, 300.0]) == [0, 1]
    assert t.step(1, [305.0, 20.0]) == [1, 0]  # order of detections does not matter
    assert t.step(2, [310.0]) == [1]  # one drops out
    assert t.step(3, [25.0, 312.0]) == [0, 1]  # and is known again within the grace
    assert t.step(9, [25.0]) == [0]  # long gone: the lowest free slot
    rnd = random.Random(1)
    for f in range(10, 200):
        slots = t.step(f, [rnd.uniform(0, 600) for _ in range(rnd.randint(0, 12))])
        assert len(set(slots)) == len(slots)


def test_lanes_wait_for_a_crossing_to_last():
    t = tracks.LaneTracker()
    assert t.step([300.0, 100.0]) == [1, 0]
    assert t.step([115.0, 210.0, 400.0]) == [0, 1, 2]  # one more person: anew, by x
    t = tracks.LaneTracker()
    t.step([100.0, 110.0])
    assert t.step([106.0, 109.0]) == [0, 1]
    assert t.step([110.0, 105.0]) == [1, 0]  # nearest pairs: still in order
    t = tracks.LaneTracker()
    t.lanes = [120.0, 110.0]  # crossed by less than the margin
    got = [t.step([120.0, 110.0]) for _ in range(tracks.HOLD)]
    assert got[:-1] == [[0, 1]] * (tracks.HOLD - 1) and got[-1] == [1, 0]  # only an order that lasts holds
    t.lanes, t.sought, t.seen = [120.0, 110.0], (), 0
    t.step([120.0, 110.0])
    assert t.step([109.0, 110.0]) in ([0, 1], [1, 0]) and t.seen <= 1  # put right in between: counted anew
    t.lanes = [200.0, 100.0]
    assert t.step([200.0, 100.0]) == [1, 0]  # far on the wrong side: at once
    assert t.step([]) == []


def test_lanes_are_one_to_one(spark, sf_dir):
    rows = tracks.st02_lanes(spark, sf_dir)
    bad = rows.groupBy("clip", "frame").agg(F.count("*").alias("n"), F.countDistinct("lane").alias("d"), F.max("lane").alias("m")).filter("n <> d or m <> n - 1")
    assert rows.count() == tracks.detections(spark, sf_dir).count() and bad.isEmpty()


def test_release_noise_is_fresh_and_of_its_scale(spark):
    flat = spark.range(20000).selectExpr("id % 7 AS label", "id AS us", "id AS ord", "50D AS value")
    got = release.released(flat, release.secure_laplace(3.0))
    a, b = (got.orderBy("ord").toPandas()["released"] for _ in range(2))
    level = round(50 / (100 / 31)) * (100 / 31)
    assert (a != b).mean() > 0.99  # drawn anew for every release
    assert abs((a - level).abs().mean() - 3.0) < 0.2 and abs((a - level).mean()) < 0.2


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitions_do_not_matter(spark, sf_dir, parts):
    rows = tracks.detections(spark, sf_dir).repartition(parts)
    got = tracks.slots(rows)
    assert got.agg(F.sum(F.hash("clip", "frame", "det", "slot"))).first()[0] == tracks.st01_slots(spark, sf_dir).agg(F.sum(F.hash("clip", "frame", "det", "slot"))).first()[0]


def test_stream_gives_the_batch_slots(spark, sf_dir, tmp_path):
    rows = tracks.detections(spark, sf_dir)
    for k, (a, b) in enumerate(((0, 3), (3, 6), (6, 10**9))):  # three arrivals, in the order of frames
        rows.filter(f"frame >= {a} and frame < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.track(stream).writeStream.format("memory").queryName("slots").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = ({tuple(r) for r in df.select("clip", "frame", "det", "slot").collect()} for df in (spark.table("slots"), tracks.st01_slots(spark, sf_dir)))
    assert got == want


def test_windows_and_sessions_in_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, df in (("days", live.windows(stream)), ("runs", live.sessions(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    from orrery.operators.relational import tumbling_days

    batch = {(r.day, r.event_type): r.n for r in tumbling_days(spark, sf_dir).collect()}
    days = spark.table("days").collect()
    assert days and all(batch[r.day.replace(tzinfo=None), r.event_type] == r.n for r in days)
    assert spark.table("runs").agg(F.sum("n")).first()[0] <= events.count()


def test_suppression_keeps_the_best_and_no_overlap(spark):
    rnd = random.Random(2)
    rows = [(1, d, x := rnd.uniform(0, 100), y := rnd.uniform(0, 100), x + 40, y + 40, rnd.random()) for d in range(60)]
    b = pd.DataFrame(rows, columns=["frame", "det", "x1", "y1", "x2", "y2", "score"])
    kept = b[b.det.isin([r.det for r in boxes.suppress(spark.createDataFrame(b)).collect()])]
    assert b.score.idxmax() in kept.index
    for i, p in kept.iterrows():
        for j, q in kept.iterrows():
            if i < j:
                w = max(0, min(p.x2, q.x2) - max(p.x1, q.x1)) * max(0, min(p.y2, q.y2) - max(p.y1, q.y1))
                assert w / (3200 - w) <= 0.3


def test_components_and_packets():
    got = masks.largest_blob(pd.DataFrame({"kind": "raw", "frame": 1, "y": [0, 0, 1, 5, 5], "x": [0, 1, 1, 5, 7]}))
    assert (got.blobs[0], got.largest[0]) == (3, 3)
    assert parse_packet(b"\x01\0\0\0\x02\0\0\0ab\x02\0\0\0\0\0\0\0") == [(1, 2, b"ab"), (2, 0, b"")]


def test_strict_gate_stops_the_job(spark):
    df = spark.range(5)
    assert audits.strict(df, F.col("id") > 10, "breach").count() == 5
    with pytest.raises(Exception, match="breach"):
        audits.strict(df, F.col("id") == 3, "breach").collect()


def test_switches_at_both_ends_by_a_plain_loop(spark, sf_dir):
    from orrery.operators.tracks import ag39_identity_switches, detections, slots

    rows = sorted(tuple(r) for r in slots(detections(spark, sf_dir)).select("clip", "frame", "x", "det", "slot").collect())
    want, last = {}, {}
    frames = {}
    for clip, frame, x, det, slot in rows:
        frames.setdefault((clip, frame), []).append(((x, det), slot))
    for (clip, _), people in sorted(frames.items()):
        now = (min(people)[1], max(people)[1])
        was = last.get(clip, now)
        n = want.get(clip, (0, 0))
        want[clip] = (n[0] + (was[0] != now[0]), n[1] + (was[1] != now[1]))
        last[clip] = now
    got = {r.clip: (r.left_switches, r.right_switches) for r in ag39_identity_switches(spark, sf_dir).collect()}
    assert got == want and sum(map(sum, want.values())) > 0
