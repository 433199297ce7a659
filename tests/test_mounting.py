"""Mounting in three dimensions against numpy, session by session."""

import numpy as np
import pytest

from driftline.operators import mounting

LIMITS = mounting.Limits(least_still=20, least_moving=12, least_samples=60)
WINDOWS = [40.0, 90.0]


def drive(seed, seconds=90, stop=True, shake=0.02):
    """Samples at 10 Hz and fixes at 1 Hz of a device with a mount of its own."""
    draw = np.random.default_rng(seed)
    t = np.arange(0, seconds, 0.1) + 0.013
    tf = np.arange(0, seconds, 1.0)
    speed = lambda x: np.where(x < 8, 0.0 if stop else 4.0, 6 + 3 * np.sin((x - 8) / 4 + seed))
    rate = 0.3 * np.sin(t / 5)
    q, _ = np.linalg.qr(draw.normal(size=(3, 3)))
    m = q * np.sign(np.linalg.det(q))  # device = m @ vehicle
    accel = np.stack([np.gradient(speed(t), t), speed(t) * rate, np.full(len(t), 9.81)], axis=1) @ m.T + draw.normal(0, shake, (len(t), 3))
    bias = draw.normal(0, 0.02, 3)
    gyro = np.stack([0 * t, 0 * t, np.where(t < 8, 0, rate) if stop else rate], axis=1) @ m.T + bias
    return np.c_[t, accel], np.c_[t, gyro], np.c_[tf, np.maximum(speed(tf), 0)], m, bias


def by_numpy(a, g, f, window, lim):
    a, g, f = (x[x[:, 0] <= window] for x in (a, g, f))
    stops = f[f[:, 1] < lim.stopped, 0]
    still = lambda x: np.array([np.any(np.abs(stops - t) <= lim.half) for t in x[:, 0]], bool)
    rest = len(stops) >= lim.least_stops and still(a).sum() >= lim.least_still
    up = (a[still(a)] if rest else a)[:, 1:].mean(axis=0)
    bias = g[still(g), 1:].mean(axis=0) if rest else np.zeros(3)
    u = up / np.linalg.norm(up)
    e1 = np.cross([1.0, 0, 0] if abs(u[0]) < 0.9 else [0, 1.0, 0], u)
    e1 /= np.linalg.norm(e1)
    e2 = np.cross(u, e1)
    rows = []
    for k in range(1, len(f) - 1):
        dt, t = f[k + 1, 0] - f[k - 1, 0], f[k, 0]
        am, gm = (x[(x[:, 0] >= t - lim.half) & (x[:, 0] < t + lim.half), 1:] for x in (a, g))
        if f[k, 1] >= lim.moving and 0 < dt <= lim.longest_gap and len(am) and len(gm):
            rows.append(((f[k + 1, 1] - f[k - 1, 1]) / dt + 1j * f[k, 1] * ((gm.mean(axis=0) - bias) @ u), am.mean(axis=0) @ e1 + 1j * (am.mean(axis=0) @ e2)))
    if len(a) < lim.least_samples or len(f) < lim.least_fixes:
        return "data", u, bias, None
    if len(rows) < lim.least_moving:
        return "moving", u, bias, None
    veh, dev = np.array(rows).T
    veh, dev = veh - veh.mean(), dev - dev.mean()
    if veh.real.std() < lim.excitation:
        return "excitation", u, bias, None
    theta = np.angle((veh * dev.conj()).sum())
    turned = np.exp(1j * theta) * dev
    r = np.corrcoef(turned.real, veh.real)[0, 1], np.corrcoef(turned.imag, veh.imag)[0, 1]
    rot = np.stack([np.cos(theta) * e1 - np.sin(theta) * e2, np.sin(theta) * e1 + np.cos(theta) * e2, u])
    return "valid" if r[0] >= lim.least_r else "r_long", u, bias, (theta, *r, rot)


def turned(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def drives():
    return {1: drive(1), 2: drive(2, stop=False), 3: drive(3, shake=8.0), 4: drive(4, seconds=20), 5: drive(5, seconds=4)}


@pytest.fixture(scope="module")
def found(spark, drives):
    frame = lambda k, cols: spark.createDataFrame([(s, *map(float, row)) for s, d in drives.items() for row in d[k]] + [(9, *[None] * len(cols)), (None, *[0.0] * len(cols))], f"session int, {', '.join(c + ' double' for c in cols)}")
    return mounting.solved(frame(0, ["t", "x", "y", "z"]).repartition(5), frame(1, ["t", "x", "y", "z"]), frame(2, ["t", "speed"]), "session", WINDOWS, LIMITS)


def test_solutions_equal_numpy(found, drives):
    rows = {(r.session, r.window): r for r in found.collect()}
    seen = set()
    for s, (a, g, f, *_) in drives.items():
        for w in WINDOWS:
            status, u, bias, fit = by_numpy(a, g, f, w, LIMITS)
            r = rows[s, w]
            assert r.status == status
            assert np.allclose(r.up, u, atol=1e-9) and np.allclose(r.bias, bias, atol=1e-9)
            if fit:
                assert np.allclose([r.theta, r.r_long, r.r_lat], fit[:3], atol=1e-7)
                assert np.allclose(turned(r.q), fit[3], atol=1e-7)
            seen.add(status)
    assert seen >= {"valid", "r_long", "data", "moving"}


def test_a_clean_drive_finds_its_mount(found, drives):
    r = next(x for x in found.collect() if (x.session, x.window) == (1, 90.0))
    *_, m, bias = drives[1]
    assert r.at_rest and np.allclose(r.bias, bias, atol=1e-6) and np.allclose(turned(r.q) @ m, np.eye(3), atol=0.06)


def test_release_is_the_first_valid_window(found):
    rows = {r.session: r for r in mounting.released(found, "session").collect()}
    assert rows[1].window == 40.0 and rows[1].refused == ""
    assert rows[3].window is None and rows[3].refused.split(",")[-1] == "r_long" and rows[5].refused == "data,data"
