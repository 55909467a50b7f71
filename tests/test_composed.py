"""The composed pass against plain NumPy that holds whole runs, with every stage written anew in its order; and its awkward cases."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import composed as c

SCHEMA = "clip long, slot long, frame long, ident long, joint int, x double, y double, conf double"


def runs_of(rows):
    """The runs of a log in plain lists: (clip, slot, run) to [(frame, {joint: (x, y)})]."""
    frames = defaultdict(dict)
    who = {}
    for r in rows:
        if r.joint < 17 and r.conf >= c.SEEN:
            frames[r.clip, r.slot, r.frame][r.joint] = (r.x, r.y)
            who[r.clip, r.slot, r.frame] = max(who.get((r.clip, r.slot, r.frame), r.ident), r.ident)
    out, before, run = defaultdict(list), None, 0
    for clip, slot, frame in sorted(frames):
        if before is None or before[:2] != (clip, slot):
            run = 1
        elif who[before] != who[clip, slot, frame]:
            run += 1
        before = (clip, slot, frame)
        out[clip, slot, run].append((frame, frames[before]))
    return out


def between(a, t):
    k = np.minimum(np.floor(t).astype(int), len(a) - 1)
    f = (t - k).reshape(-1, *[1] * (a.ndim - 1))
    nxt = a[np.minimum(k + 1, len(a) - 1)]
    return np.where(f == 0, a[k], (1 - f) * a[k] + f * nxt)


def clock_of(key, n):
    u = lambda s: np.array([c.draw(s, *key, i) for i in range(n)])
    g = np.sqrt(-2 * np.log(1 - u("wa"))) * np.cos(2 * np.pi * u("wb"))

    def beside(k):
        return sum(np.array([g[i + s] if 0 <= i + s < n else g[i] for i in range(n)]) for s in (-k, k))

    w = 0.4 * g + 0.25 * beside(1) + 0.05 * beside(2)
    speed = np.clip(1 + 0.3 * w / (np.abs(w).max() + 1e-9), 0.4, 1.6)
    cum = np.cumsum(speed) - speed[0]
    return cum / (cum.max() - cum.min() + 1e-9) * (n - 1)


def plain(arm, key, frames):
    """(raw, made, held, moved) of a run, arrays of frames x 17 (x 2), or its state where it is not done."""
    n, seed, rad = len(frames), "|".join(map(str, ("", *key))), np.deg2rad
    raw = np.full((n, 17, 2), np.nan)
    for t, (_, joints) in enumerate(frames):
        for j, at in joints.items():
            raw[t, j] = at
    if n < c.FLOOR:
        return "short"
    full = lambda a: np.concatenate([a, (a[:, 11:12] + a[:, 12:13]) / 2, (a[:, 5:6] + a[:, 6:7]) / 2], axis=1)
    hips = lambda a: (a[:, 11:12] + a[:, 12:13]) / 2
    body = full(raw)
    tall = max(1.0, np.median(np.nanmax(raw[:, :, 1], 1) - np.nanmin(raw[:, :, 1], 1)))
    lengths = {g: np.concatenate([np.hypot(*(body[:, a] - body[:, b]).T) for a, b, k in c.BONES if k == g]) for g in c.GROUPS}
    median = {g: np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else np.nan for g, v in lengths.items()}
    if any(m < c.THIN for m in median.values()):
        return "degenerate"
    width = next(w for w in (2 * median["clav"], median["spine"] / c.BUILD["spine"], tall / (0.6 + 1.231 + 1.047 + 1.051)) if not np.isnan(w))
    # the build
    still = c.noise(seed, 2**31 - 1, 9)
    slow, noise = np.zeros((n, 43)), np.zeros(43)
    for t in range(n):
        noise = 0.9 * noise + np.sqrt(1 - 0.81) * c.noise(seed, t, 43)
        slow[t] = noise
    out = np.full((n, 19, 2), np.nan)
    out[:, 17] = body[:, 17]
    for child, parent, g in c.BONES:
        k = c.GROUPS.index(g)
        a = rad(arm.angle) * still[k] + rad(arm.drift) * slow[:, k] if g in c.LIMBS else np.zeros(n)
        v = body[:, child] - body[:, parent]
        scale = 1.0 if np.isnan(median[g]) else width * c.BUILD[g] / median[g]
        out[:, child] = out[:, parent] + scale * np.stack([v[:, 0] * np.cos(a) - v[:, 1] * np.sin(a), v[:, 0] * np.sin(a) + v[:, 1] * np.cos(a)], 1)
    out = out[:, :17] + arm.sway * tall * slow[:, 9:].reshape(n, 17, 2)
    places = np.arange(n, dtype=float)
    if arm.cadence:
        out = between(out - hips(out), clock_of(("", *key), n)) + hips(out)
    if arm.phase:
        new = out.copy()
        for k, (anchor, joints) in enumerate(c.CHAINS):
            t = np.clip(places + arm.phase * (2 * c.draw(seed, "phase", k) - 1), 0, n - 1)
            for j in joints:
                new[:, j] = out[:, anchor] + between(out[:, j] - out[:, anchor], t)
        out = new
    if arm.sigma:
        rel, new = out - hips(out), out.copy()
        for t in range(n):
            near = range(max(0, t - 3), min(n - 1, t + 3) + 1)
            for j in range(17):
                ok = [s for s in near if not np.isnan(rel[s, j]).any()]
                if not np.isnan(out[t, j]).any():
                    w = np.exp(-0.5 * ((np.array(ok) - t) / arm.sigma) ** 2)
                    new[t, j] = (w[:, None] * rel[ok, j]).sum(0) / w.sum() + hips(out)[t, 0]
        out = new
    if arm.path:
        t = np.clip(places + arm.path * np.sin(2 * np.pi * places / arm.period + 2 * np.pi * c.draw(seed, "path")), 0, n - 1)
        d = between(hips(out)[:, 0], t) - hips(out)[:, 0]
        far = np.hypot(*d.T)
        d = np.where(far[:, None] > arm.part * tall, d * arm.part * tall / far[:, None], d)
        out = out + np.nan_to_num(d)[:, None]
    if arm.swing:
        new = out.copy()
        for k, (anchor, joints) in enumerate(c.CHAINS):
            total, scale = 0j, arm.swing * (2 * c.draw(seed, "swing", k) - 1)
            for t in range(n):
                z = complex(*(out[t, joints[0]] - out[t, anchor]))
                if np.isnan(z) or z == 0:
                    continue
                total += z / abs(z)
                turn = np.exp(1j * scale * np.angle(z * np.conj(total)))
                for j in joints:
                    w = complex(*(out[t, j] - out[t, anchor])) * turn
                    new[t, j] = out[t, anchor] + (w.real, w.imag)
        out = new
    # what follows the walk
    med = lambda a: np.median(a[~np.isnan(a)]) if (~np.isnan(a)).any() else np.nan
    if arm.fit:
        a, b = (med(np.abs(x[:, 5, 0] - x[:, 6, 0])) for x in (raw, out))
        s = 1.0 if np.isnan(a) or np.isnan(b) or b == 0 else min(2.0, max(0.5, a / b))
        if s != 1.0:
            out[:, :, 0] = hips(out)[:, :, 0] + s * (out[:, :, 0] - hips(out)[:, :, 0])
    if arm.head:
        out[:, :5] += np.nan_to_num(raw[:, 0] - out[:, 0])[:, None]
    d = out - raw
    far = np.hypot(d[:, :, 0], d[:, :, 1])
    held = (far > arm.cap * tall) if arm.cap else np.zeros_like(far, bool)
    out = np.where(held[:, :, None], raw + d * (arm.cap * tall) / np.where(held, far, 1)[:, :, None], out)
    return out, held, out - raw


def expected(rows, arm, canvas):
    done, state = {}, {}
    for key, frames in runs_of(rows).items():
        got = plain(arm, key, frames)
        for t, (frame, _) in enumerate(frames):
            state[key[0], key[1], frame] = (key[2], got if isinstance(got, str) else "done")
            if not isinstance(got, str):
                done[key[0], key[1], frame] = tuple(a[t] for a in got)
    out = {}
    for r in rows:
        run, status = state.get((r.clip, r.slot, r.frame), (None, "absent"))
        if status != "done":
            out[r.clip, r.slot, r.frame, r.joint] = (r.x, r.y, status, False)
            continue
        at, held, moved = done[r.clip, r.slot, r.frame]
        anchor = r.joint if r.joint < 17 else next((a for f, l, a in c.ATTACHED if f <= r.joint <= l), None)
        if r.conf < c.SEEN or anchor is None or np.isnan(moved[anchor]).any():
            continue
        x, y = at[anchor] if r.joint < 17 else np.array([r.x, r.y]) + moved[anchor]
        if canvas:
            x, y = min(canvas[0], max(0, x)), min(canvas[1], max(0, y))
        out[r.clip, r.slot, r.frame, r.joint] = (x, y, "done", bool(held[anchor]))
    return out


@pytest.mark.parametrize("arm, canvas", [(c.SHIPPED, c.CANVAS), (c.ARMS[0], None), (c.ARMS[1], c.CANVAS)])
def test_stages_in_order_over_the_whole_table(spark, sf_dir, arm, canvas):
    log = c.whole_log(spark, sf_dir)
    want = expected(log.collect(), arm, canvas)
    got = {(r.clip, r.slot, r.frame, r.joint): (r.x, r.y, r.status, r.held) for r in c.composed(log, (arm,), canvas=canvas).collect()}
    assert set(got) == set(want) and len(got) > 500
    assert {s for *_, s, _ in got.values()} >= {"done", "short"}
    for k, (x, y, status, held) in got.items():
        assert status == want[k][2] and held == want[k][3], k
        assert abs(x - want[k][0]) < 0.011 and abs(y - want[k][1]) < 0.011, (k, x, y, want[k])


def test_no_stage_leaves_the_figure_as_it_is_and_order_matters():
    rnd = np.random.default_rng(3)
    still = c.Arm("still", rebuild=False, cadence=False, phase=0, sigma=0, path=0, swing=0)
    f = c.Frame(0, 7, 0.0, rnd.uniform(0, 100, (17, 2)), None)
    assert c.through(c.chain(still, "s", 1, {}, 1.0), f) == [f]
    names = [type(s).__name__ for s in c.chain(c.SHIPPED, "s", 9, dict.fromkeys(c.GROUPS, 1.0), 1.0)]
    assert names == ["Rebuilt", "Cadence", "Phase", "Smooth", "Path", "Swing"]


def test_a_long_run_holds_few_samples():
    n, stages = 4000, c.chain(c.SHIPPED, "s", 4000, dict.fromkeys(c.GROUPS, 1.0), 100.0)
    rnd, most, out = np.random.default_rng(4), 0, []
    for i in range(n):
        at = rnd.uniform(0, 100, (17, 2))
        out += c.through(stages, c.Frame(i, i, min(n - 1.0, max(0.0, i + 2.5 * np.sin(i / 40))), at, at))
        most = max(most, *(len(s.held) for s in stages if isinstance(s, c.Reading)))
    assert [f.frame for f in out] == list(range(n)) and most <= 4 * c.AROUND


def test_awkward_rows(spark):
    def frame(f, ident, n=17, conf=0.9, spread=10.0):
        return [(1, 0, f, ident, j, 100 + spread * (j % 4) + f, 50 + spread * j, conf) for j in range(n)]

    rows = [r for f in range(12) for r in frame(f, None)]  # nobody's name is a name
    rows += [r for f in range(20, 24) for r in frame(f, 5)]  # short
    rows += [r for f in range(30, 40) for r in frame(f, 6, spread=0.0)]  # no length
    rows += frame(50, 6, conf=0.1)  # nobody seen
    rows += [(1, 0, 3, None, 100, 1.0, 2.0, 0.9), (1, 0, 3, None, 40, 1.0, 2.0, 0.9), (1, 0, 3, None, 115, None, 2.0, 0.9)]
    rows += [(1, 0, 4, None, 9, float("nan"), 1.0, 0.95)]  # a second wrist without a place
    rows += rows[:17]
    log = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS status", "1 AS run", "2 AS held", "3 AS tall")
    out = c.composed(log).collect()
    by = defaultdict(set)
    for r in out:
        by[r.status].add(r.frame)
    assert by == {"done": set(range(12)), "short": {20, 21, 22, 23}, "degenerate": set(range(30, 40)), "absent": {50}}
    assert len(out) == len({(r.frame, r.joint) for r in out})
    three = {r.joint for r in out if r.frame == 3}
    assert three == {*range(17), 100}  # the hand goes with its wrist; the face and a joint without a place go
    assert all(0 <= r.x <= 640 and 0 <= r.y <= 480 for r in out)
    assert {r.status for r in c.composed(log, unfit="drop").collect()} == {"done", "absent"}
    with pytest.raises(Exception, match="degenerate"):
        c.composed(log, unfit="raise").collect()
    assert c.composed(log.limit(0)).collect() == []
    a, b = (c.composed(log.filter("frame < 12"), salt=s).filter(F.col("joint") == 9).orderBy("frame").collect() for s in "ab")
    assert [r.x for r in a] != [r.x for r in b]


def test_short_runs_are_made_together_and_long_ones_frame_by_frame_alike(spark, sf_dir, monkeypatch):
    log = c.whole_log(spark, sf_dir)
    arms = (c.SHIPPED, c.ARMS[1])
    walked = {tuple(r)[:5]: [np.array(a, float) for a in tuple(r)[5:9]] for r in c.walked(log, arms, "s")[0].select(*c.RUN, "frame", "rx", "ry", "mx", "my").collect()}
    rows = c.walked(log, arms, "s")[1].filter("status = 'done'").count()
    assert len(walked) == 2 * rows > 100
    runs = spark.createDataFrame([(1, 0, 1, f, f, 40, f * 1.0, 100.0, [1.0] * len(c.GROUPS), [None if j == f else float(j * f % 50) for j in range(17)], [None if j == f else j + 1.0 for j in range(17)]) for f in range(40)],
                                 "clip long, slot long, run long, frame long, i int, n long, t double, tall double, factors array<double>, xs array<double>, ys array<double>")
    runs = runs.coalesce(1).sortWithinPartitions("frame")
    got = []
    for long in (39, 40):
        monkeypatch.setattr(c, "LONG", long)
        made = runs.mapInArrow(c.walker(arms, "s"), c.WALKED).orderBy("arm", "frame").collect()
        got.append(np.array([[*r.rx, *r.ry, *r.mx, *r.my] for r in made], float))
    assert got[0].shape == (80, 68) and np.allclose(*got, equal_nan=True, rtol=0, atol=1e-9)


def test_no_frame_of_a_short_run_is_walked_by_itself():
    rnd, n = np.random.default_rng(5), np.repeat([7, 9, 5], [7, 9, 5])
    i = np.concatenate([np.arange(7), np.arange(9), np.arange(5)])
    raw = rnd.uniform(0, 100, (21, 17, 2))
    raw[4, 3] = raw[12, 11] = np.nan
    t, tall, factors = i * 0.9, np.full(21, 80.0), rnd.uniform(0.5, 2, (21, len(c.GROUPS)))
    at = c.Runs(["a", "b", "c"], i, n, t, tall, factors, raw).made(c.SHIPPED)
    for r, (s, seed) in enumerate(zip((0, 7, 16), "abc", strict=True)):
        stages = c.chain(c.SHIPPED, seed, int(n[s]), dict(zip(c.GROUPS, factors[s], strict=True)), 80.0)
        want = []
        for k in range(s, s + n[s]):
            stages[0].factors = dict(zip(c.GROUPS, factors[k], strict=True))
            want += c.through(stages, c.Frame(int(i[k]), k, t[k], raw[k], raw[k]))
        assert np.allclose([f.at for f in want], at[s : s + n[s]], equal_nan=True, rtol=0, atol=1e-9), r
