"""Straight segments and the mount's state against plain loops."""

import math
from collections import defaultdict

import numpy as np
import pytest

from driftline.operators import in_motion
from driftline.plans import mounts

M = mounts.IN_MOTION
wrap = lambda d: abs((d + 180) % 360 - 180)


def level(u, v):
    """v turned by the least rotation that brings u upright."""
    u = np.array(u) / np.linalg.norm(u)
    axis, c = np.cross(u, [0, 0, 1.0]), u[2]
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return (np.eye(3) + k + k @ k / (1 + c)) @ v


def runs(fixes):
    out = []
    for f in fixes:
        if f.speed is None or f.speed < M.moving:
            out.append([])
        elif out and out[-1] and f.t - out[-1][0].t < M.longest * (1 + math.floor((out[-1][-1].t - out[-1][0].t) / M.longest)):
            out[-1].append(f)
        elif out and out[-1]:
            out.append([f])
        else:
            out.append([f])
    return [r for r in out if r]


def segment(fs, samples, rests):
    up = [x for x in rests if x.t <= fs[0].t]
    own = [s for s in samples if fs[0].t <= s.t <= fs[-1].t]
    acc = [f.accuracy for f in fs if f.accuracy is not None]
    if len(fs) < M.least_fixes:
        return "SPARSE", None
    if not acc or max(acc) > M.most_accuracy:
        return "INACCURATE", None
    if not own:
        return "NO_SAMPLES", None
    if not up:
        return "NO_TILT", None
    u = np.array([up[-1].ux, up[-1].uy, up[-1].uz])
    u = u / np.linalg.norm(u)
    straight = [s for s in own if abs(np.dot([s.wx, s.wy, s.wz], u)) <= M.straight_rate]
    if not straight or len(straight) / len(own) < M.straight_share:
        return "NOT_STRAIGHT", None
    h = np.mean([np.array([s.fx, s.fy, s.fz]) - np.dot([s.fx, s.fy, s.fz], u) * u for s in straight], axis=0)
    force = np.linalg.norm(h)
    if force < M.excitation:
        return "EXCITATION", None
    slope = np.polyfit([f.t for f in fs], [f.speed for f in fs], 1)[0]
    if abs(slope) < M.slope:
        return "SLOPE", None
    if not M.ratio_low <= force / abs(slope) <= M.ratio_high:
        return "MISMATCH", None
    courses = [f.course for f in fs if f.course is not None]
    if courses:
        east, north = fs[-1].east - fs[0].east, fs[-1].north - fs[0].north
        if max(wrap(c - courses[0]) for c in courses) > M.course_spread:
            return "COURSE", None
        if math.hypot(east, north) < M.baseline:
            return "BASELINE", None
        if wrap(math.degrees(math.atan2(east, north)) - courses[0]) > M.course_displacement:
            return "DISPLACEMENT", None
    p = level(u, h) * np.sign(slope)
    return "ACCEPTED", -math.atan2(p[1], p[0])


@pytest.fixture(scope="module")
def tables(spark, sf):
    out = []
    for df in mounts.moves(spark, sf):
        by = defaultdict(list)
        for r in df.orderBy("user_id", "t").collect():
            by[r.user_id].append(r)
        out.append(by)
    return out


def test_segments(spark, sf, tables):
    fixes, samples, rests = tables
    got = defaultdict(list)
    for r in in_motion.segments(*mounts.moves(spark, sf), "user_id", M).orderBy("segment").collect():
        got[r.user_id].append(r)
    seen = set()
    for user, fs in fixes.items():
        found = []
        for run in runs(fs):
            start = run[0].t
            parts = defaultdict(list)
            for f in run:
                parts[math.floor((f.t - start) / M.longest)].append(f)
            found += parts.values()
        assert len(found) == len(got[user])
        for part, r in zip(found, got[user], strict=True):
            code, yaw = segment(part, samples[user], rests[user])
            assert (r.t, r.code) == (part[-1].t, code) and (yaw is None) == (r.yaw is None)
            assert yaw is None or abs(math.remainder(yaw - r.yaw, 2 * math.pi)) < 1e-9
            seen.add(code)
    assert seen >= {"ACCEPTED", "SPARSE", "SLOPE", "NOT_STRAIGHT"}


def test_states(spark):
    """A scripted drive: pending, valid, handled, valid again, contradicted, tilted."""
    lim = in_motion.Limits(evidence=3)
    up, tilted = (0.0, 0.0, 1.0), (math.sin(0.5), 0.0, math.cos(0.5))
    script = [
        ("rest", up, "", "PENDING", 0), ("segment", 0.10, "", "PENDING", 1), ("turn", 0.3, "", "PENDING", 1), ("segment", 0.12, "", "VALID", 2), ("turn", 0.2, "", "VALID", 2), ("turn", 0.2, "REMOUNT_TURN", "EXPIRED", 0),
        ("segment", 0.4, "", "PENDING", 1), ("segment", 0.41, "", "VALID", 2), ("segment", 0.42, "", "VALID", 3), ("segment", 0.43, "", "VALID", 3), ("rest", up, "", "VALID", 3), ("segment", 1.5, "INCONSISTENT", "INVALID", 0),
        ("segment", 0.0, "", "PENDING", 1), ("segment", math.pi, "CONTRADICTORY", "INVALID", 0), ("rest", tilted, "REMOUNT_TILT", "EXPIRED", 0), ("segment", 3.1, "", "PENDING", 1), ("segment", -3.1, "", "VALID", 2), ("rest", tilted, "", "VALID", 2),
    ]
    sessions = {s: script[:n] for s, n in ((1, len(script)), (2, 6), (3, 1))}
    pick = lambda kind: [(s, float(t), x) for s, rows in sessions.items() for t, (k, x, *_) in enumerate(rows) if k == kind]
    rests = spark.createDataFrame([(s, t, *x) for s, t, x in pick("rest")], "session int, t double, ux double, uy double, uz double")
    found = spark.createDataFrame([(s, t, "ACCEPTED", x) for s, t, x in pick("segment")] + [(1, 2.5, "SPARSE", None)], "session int, t double, code string, yaw double")
    turns = spark.createDataFrame(pick("turn"), "session int, t double, turned double")
    got = in_motion.estimated(rests, found, turns, "session", lim).orderBy("session", "t").collect()
    want = [(s, float(t), k, event, status, n) for s, rows in sessions.items() for t, (k, _, event, status, n) in enumerate(rows)]
    assert [(r.session, r.t, r.kind, r.event, r.status, r.evidence) for r in got] == want
    assert abs(abs(got[16].yaw) - math.pi) < 1e-9 and abs(got[9].yaw - 0.42) < 1e-9 and got[5].yaw is None


def test_handling(spark, sf, tables):
    fixes, samples, _ = tables
    want = {}
    for user, ss in samples.items():
        for a, b in zip(ss, ss[1:], strict=False):
            rate = math.sqrt(b.wx**2 + b.wy**2 + b.wz**2)
            speed = [f.speed for f in fixes[user] if f.t <= b.t]
            if rate >= M.handling_rate and speed and speed[-1] <= M.parked:
                want[user, b.t] = rate * min(b.t - a.t, M.longest_pair)
    f, s, _ = mounts.moves(spark, sf)
    got = {(r.user_id, r.t): r.turned for r in in_motion.handling(s, f, "user_id", M).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
