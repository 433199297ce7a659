"""The fifteen-state filter against a filter of one session that goes step by step and row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import inertial, stacked

A, F_ = 6378137.0, 1 / 298.257223563
E2 = F_ * (2 - F_)


def hamilton(p, q):
    a, b, c, d = p
    e, f, g, h = q
    return np.array([a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e])


def exponential(r):
    a = math.sqrt(sum(x * x for x in r))
    return np.array([1.0, *(np.array(r) / 2)]) if a < 1e-12 else np.array([math.cos(a / 2), *(math.sin(a / 2) / a * np.array(r))])


def rotated(q, v):
    return hamilton(hamilton(q, np.r_[0, v]), q * [1, -1, -1, -1])[1:]


def cross(v):
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


class One:
    """One session, one row at a time; measurements row by row."""

    def __init__(self, arm):
        self.arm, self.on, self.failed = arm, False, False

    def noise(self, dt):
        a, q = self.arm, np.zeros((15, 15))
        i = np.eye(3)
        q[:3, :3], q[:3, 3:6], q[3:6, :3], q[3:6, 3:6] = (a.accel_noise**2 * x * i for x in (dt**3 / 3, dt**2 / 2, dt**2 / 2, dt))
        q[6:9, 6:9], q[9:12, 9:12], q[12:, 12:] = a.gyro_noise**2 * dt * i, a.gyro_walk**2 * dt * i, a.accel_walk**2 * dt * i
        return q

    def row(self, t, kind, z, r):
        if kind not in inertial.KINDS:
            return "unknown", None
        if kind in self.arm.off:
            return "off", None
        if kind == "align":
            if len(z) < 10 or len(r) < 5 or min(r) <= 0:
                return "invalid", None
            self.on, self.failed, self.moved, self.t, self.span, self.tried = True, False, False, t, 0.0, None
            self.v, self.q, self.anchor = np.array(z[:3], float), np.array(z[3:7]) / np.linalg.norm(z[3:7]), z[7:10]
            self.p, self.b, self.c, self.last = np.zeros(3), np.zeros(3), np.zeros(3), np.zeros(3)
            self.cov = np.diag(np.repeat(np.array(r, float), 3))
            return "aligned", None
        if not self.on or self.failed:
            return "failed" if self.on else "unaligned", None
        if kind == "sample":
            return self.sample(t, np.array(z[:3]), np.array(z[3:6])), None
        if kind == "inflate":
            if not z or z[0] <= 0:
                return "invalid", None
            self.cov[6:9, 6:9] += np.eye(3) * z[0]
            return "inflated", None
        return self.measure(t, kind, z, r)

    def sample(self, t, f, w):
        dt = t - self.t
        if not np.isfinite([*f, *w]).all():
            self.failed = True
            return "not_finite"
        if dt < 0:
            return "backwards"
        if dt < 1e-9:
            return "duplicate"
        if dt > self.arm.longest_gap:
            self.failed = True
            return "gap"
        if dt > self.arm.longest_step:
            self.cov, self.t = self.cov + self.noise(dt), t
            return "held"
        lat0, h0 = math.radians(self.anchor[0]), self.anchor[2]
        lat = lat0 + self.p[1] / (A * (1 - E2) / (1 - E2 * math.sin(lat0) ** 2) ** 1.5 + h0)
        h, s = h0 + self.p[2], math.sin(lat)
        n, m = A / math.sqrt(1 - E2 * s * s), A * (1 - E2) / (1 - E2 * s * s) ** 1.5
        rate = 7.292115e-5 * np.array([0, math.cos(lat), s])
        over = np.array([-self.v[1] / (m + h), self.v[0] / (n + h), self.v[0] * math.tan(lat) / (n + h)])
        g = 9.7803253359 * (1 + 0.00193185265241 * s * s) / math.sqrt(1 - E2 * s * s) * (1 - 2 / A * (1 + F_ + 0.00344978650684 - 2 * F_ * s * s) * h + 3 * h * h / A / A)
        q = hamilton(hamilton(exponential(-(rate + over) * dt), self.q), exponential((w - self.b) * dt))
        self.q = q / np.linalg.norm(q)
        force = rotated(self.q, f - self.c)
        acc = force - [0, 0, g] - np.cross(2 * rate + over, self.v)
        v = self.v + (acc if not self.moved else (acc + self.last) / 2) * dt
        self.p, self.v, self.last, self.moved, self.t = self.p + (self.v + v) / 2 * dt, v, acc, True, t
        c = np.stack([rotated(self.q, e) for e in np.eye(3)], axis=1)
        x = np.zeros((15, 15))
        x[:3, 3:6] = np.eye(3)
        x[3:6, 3:6], x[3:6, 6:9], x[3:6, 12:], x[5, 2] = -cross(2 * rate + over), -cross(force), -c, 3.086e-6
        x[6:9, 6:9], x[6:9, 9:12] = -cross(rate + over), -c
        phi = np.eye(15) + x * dt
        self.cov = phi @ self.cov @ phi.T + self.noise(dt)
        return "propagated"

    def measure(self, t, kind, z, r):
        rows = []
        unit = lambda k, v=1.0: np.eye(15)[k] * v
        along = lambda a: np.r_[np.zeros(3), a, np.zeros(9)]
        if kind == "position":
            rows = [(unit(k), z[k] - self.p[k], r[k]) for k in range(min(len(z), len(r), 3))]
        elif kind == "velocity":
            rows = [(unit(3), z[0] * math.sin(z[1]) - self.v[0], r[0]), (unit(4), z[0] * math.cos(z[1]) - self.v[1], r[0])]
        elif kind == "speed":
            flat = math.hypot(*self.v[:2])
            if flat < self.arm.least_speed:
                return "invalid", None
            rows = [(along([*self.v[:2] / flat, 0]), z[0] - flat, r[0])]
        elif kind == "still":
            rows = [(unit(3 + k), -self.v[k], r[0]) for k in range(3)]
        elif kind in ("sideways", "forward"):
            m = np.array(z[-4:]) / np.linalg.norm(z[-4:])
            axes = [rotated(hamilton(self.q, m), e) for e in np.eye(3)]
            rows = [(along(axes[0]), z[0] - axes[0] @ self.v, r[0])] if kind == "forward" else [(along(axes[k]), -axes[k] @ self.v, r[k - 1]) for k in (1, 2)]
        elif kind == "heading":
            rows = [(unit(8, -1.0), z[0], r[0])]
        elif kind == "cross":
            if abs(math.hypot(z[0], z[1]) - 1) > 1e-6:
                return "invalid", None
            rows = [(np.r_[z[0], z[1], np.zeros(13)], z[2], r[0])]
        if any(not np.isfinite(y) or not np.isfinite(v) or v <= 0 for _, y, v in rows):
            return "invalid", None
        h, y, v = np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        test = float(y @ np.linalg.solve(h @ self.cov @ h.T + np.diag(v), y))
        fix = kind in ("position", "velocity", "speed")
        if test > {1: 10.8276, 2: 13.8155, 3: 16.2662}[len(y)]:
            if fix:
                gap = 0.0 if self.tried is None else t - self.tried
                self.span, self.tried = (self.span + gap if gap <= self.arm.rejected_gap else 0.0), t
                if self.span > self.arm.rejected_for:
                    self.failed = True
                    return "rejected_too_long", test
            return "gate", test
        if kind == "position":
            self.span = 0.0
        x = np.zeros(15)
        for a, b, c in zip(h, y, v, strict=True):  # each row of its own, which is the same as all at once
            s = a @ self.cov @ a + c
            k = self.cov @ a / s
            x = x + k * (b - a @ x)
            i = np.eye(15) - np.outer(k, a)
            self.cov = i @ self.cov @ i.T + c * np.outer(k, k)
        self.p, self.v, self.b, self.c = self.p + x[:3], self.v + x[3:6], self.b + x[9:12], self.c + x[12:]
        q = hamilton(exponential(x[6:9]), self.q)
        self.q = q / np.linalg.norm(q)
        return "accepted", test


def session(seed, n=150):
    """Rows of one session: every kind, gaps, repeats, refusals, and what is invalid."""
    draw = np.random.default_rng(seed)
    rows, t = [(0.0, "position", [0.0, 0.0], [4.0, 4.0])], 1.0
    rows.append((t, "align", [5.0, 1.0, 0.0, 0.96, 0.05, -0.02, 0.2, 12.9 + seed, 77.5, 900.0], [9.0, 1.0, 0.02, 1e-4, 1e-2]))
    for k in range(n):
        t += float(draw.choice([0.1, 0.1, 0.1, 0.02, 0.0, 0.4])) if k != 100 or seed % 3 else 6.0
        rows.append((t, "sample", [*draw.normal(0, 0.6, 2).tolist(), 9.8, *draw.normal(0, 0.05, 3).tolist()], []))
        for kind in draw.permutation(["position", "velocity", "speed", "still", "sideways", "forward", "heading", "cross", "inflate"])[: int(draw.integers(0, 4))]:
            far = 1e4 if draw.random() < 0.1 else 1.0
            m = draw.normal(size=4)
            a = draw.random() * 6
            z, r = {
                "position": ([*(draw.normal(0, 4, 3) * far).tolist()][: int(draw.integers(2, 4))], [9.0, 9.0, 16.0]),
                "velocity": ([float(draw.random() * 6 * far), a], [1.0]),
                "speed": ([float(draw.random() * 6)], [1.0 if draw.random() < 0.9 else 0.0]),
                "still": ([], [float(draw.choice([4.0, 1e-3]))]),
                "sideways": (m.tolist(), [4.0, 4.0]),
                "forward": ([float(draw.random() * 6), *m.tolist()], [2.0]),
                "heading": ([float(draw.normal(0, 0.1))], [0.05]),
                "cross": ([math.cos(a), math.sin(a) * float(draw.choice([1.0, 1.1])), float(draw.normal(0, 3))], [9.0]),
                "inflate": ([float(draw.choice([0.01, -1.0]))], []),
            }[str(kind)]
            rows.append((t, str(kind), z, r[: len(z)] if kind == "position" else r))
    return rows + [(t + 0.05, "other", [1.0], [1.0])]


ARMS = (inertial.Arm(), inertial.Arm("fixes", off=("still", "sideways", "forward", "heading", "cross")), inertial.Arm("noisy", accel_noise=0.5, gyro_noise=0.05, longest_step=1.0))
STATE = ["px", "py", "pz", "vx", "vy", "vz", "qw", "qx", "qy", "qz", "bgx", "bgy", "bgz", "bax", "bay", "baz", "sigma_p", "sigma_v", "sigma_yaw"]


@pytest.fixture(scope="module")
def rows():
    return {s: session(s, 40 + 25 * s) for s in range(1, 7)}


def frame(spark, rows):
    flat = [(s, *r) for s, rs in rows.items() for r in rs]
    return spark.createDataFrame(flat, "session int, t double, kind string, z array<double>, r array<double>").repartition(5)


def alike(a, b):
    """The same rows, but for the last digits of sums that numpy takes in another order."""
    key = lambda r: (r.session, r.arm, r.t, r.kind, r.outcome, round(r.px or 0, 6), round(r.sigma_p or 0, 6), round(r.sigma_yaw or 0, 6), round(r.qz or 0, 6))
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert [key(r)[:5] for r in a] == [key(r)[:5] for r in b]
    assert np.allclose([[r[c] for c in STATE] for r in a], [[r[c] for c in STATE] for r in b], rtol=1e-8, atol=1e-9)


def ordered(rs):
    rank = {k: i for i, k in enumerate(inertial.KINDS, 1)}
    return sorted(rs, key=lambda r: (r[0], rank.get(r[1], 0), r[2], r[3]))


def test_every_update_equals_one_session_at_a_time(spark, rows):
    got = inertial.navigated(frame(spark, rows), "session", arms=ARMS, samples=True).collect()
    held = {}
    for r in got:
        held.setdefault((r.session, r.arm), []).append(r)
    seen = set()
    for s, rs in rows.items():
        for arm in ARMS:
            one, mine = One(arm), held[s, arm.name]
            assert len(mine) == len(rs)
            # rows of one time and kind may come in any order, so they are matched as they came
            for want, r in zip(ordered(rs), mine, strict=True):
                t, kind, z, zr = want
                outcome, test = one.row(t, kind, z, zr)
                assert (r.t, r.kind, r.outcome) == (t, kind, outcome)
                seen.add(outcome)
                assert (test is None) == (r.nis is None)
                if test is not None:
                    assert math.isclose(r.nis, test, rel_tol=1e-6, abs_tol=1e-9)
                if one.on and not one.failed:
                    state = [*one.p, *one.v, *one.q, *one.b, *one.c, math.sqrt(one.cov[0, 0] + one.cov[1, 1]), math.sqrt(one.cov[3, 3] + one.cov[4, 4]), math.sqrt(one.cov[8, 8])]
                    assert np.allclose([r[c] for c in STATE], state, rtol=1e-6, atol=1e-7)
    assert seen >= {"aligned", "propagated", "held", "duplicate", "gap", "accepted", "gate", "invalid", "unaligned", "failed", "off", "unknown", "inflated"}


def test_arms_share_one_exchange_and_equal_their_own_run(spark, rows):
    df = frame(spark, rows)
    out = inertial.navigated(df, "session", arms=ARMS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for arm in ARMS:
        alone = inertial.navigated(df, "session", arms=(arm,)).collect()
        alike(alone, [r for r in out.collect() if r.arm == arm.name])


def test_batches_and_partitions_change_nothing(spark, rows):
    df = frame(spark, rows)
    want = inertial.navigated(df, "session").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        alike(inertial.navigated(df, "session").collect(), want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_covariance_stays_sound_over_many_steps():
    import pyarrow as pa

    stack = inertial.Navigation(1, (inertial.Arm(),), True, False)
    row = lambda t, kind, z, r: pa.table({"t": [t], "kind": [kind], "z": pa.array([z], pa.list_(pa.float64())), "r": pa.array([r], pa.list_(pa.float64()))})
    stack.step(row(0.0, "align", [0, 0, 0, 1, 0, 0, 0, 12.9, 77.5, 900.0], [9.0, 1.0, 0.02, 1e-4, 1e-2]))
    for k in range(1, 20_001):
        stack.step(row(k / 100, "sample", [0.01, 0.0, 9.784, 0.0, 0.0, 0.0], []))
        if k % 50 == 0:
            stack.step(row(k / 100, "position", [0.0, 0.0, 0.0], [25.0, 25.0, 50.0]))
            stack.step(row(k / 100, "still", [], [0.01]))
    p = stack.cov[0]
    assert np.array_equal(p, p.T) and np.linalg.eigvalsh(p).min() > 0 and not stack.failed[0]
    assert np.abs(stack.p[0]).max() < 5


def test_propagation_alone_of_a_resting_device_stays(spark):
    rows = [(0.0, "align", [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 45.0, 7.0, 0.0], [1.0] * 5)]
    e = 7.292115e-5
    rest = [0.0, 0.0, 9.806197765, 0.0, e * math.cos(math.radians(45)), e * math.sin(math.radians(45))]
    rows += [(k / 10, "sample", rest, []) for k in range(1, 600)]
    df = spark.createDataFrame([(None, *r) for r in rows], "session int, t double, kind string, z array<double>, r array<double>")
    last = max(inertial.navigated(df, "session", covariance=False, samples=True).collect(), key=lambda r: r.t)
    assert last.session is None and abs(last.px) + abs(last.py) < 1e-6 and abs(last.pz) < 1e-2 and math.isclose(last.qw, 1.0, abs_tol=1e-12)


def test_the_queries_rows_equal_one_session_at_a_time(spark, sf):
    """The derived drives move every output, and the filter stays near their way."""
    from driftline.plans import inertial as plan

    rows = plan.rows(spark, sf).filter("user_id < 4").collect()
    way = {(r.user_id, round(r.t, 3)): (r.east, r.north) for r in plan.motion(spark, sf).filter("user_id < 4").collect()}
    got = {}
    for r in inertial.navigated(spark.createDataFrame(rows, "user_id long, t double, kind string, z array<double>, r array<double>"), "user_id").collect():
        got[r.user_id, round(r.t, 3), r.kind] = r
    off = []
    for user in sorted({r.user_id for r in rows}):
        one = One(inertial.Arm())
        for t, kind, z, zr in ordered([(r.t, r.kind, r.z, r.r) for r in rows if r.user_id == user]):
            outcome, _ = one.row(t, kind, z, zr)
            if kind != "sample":
                r = got[user, round(t, 3), kind]
                assert r.outcome == outcome and np.allclose([r.px, r.py, r.vx, r.qz, r.baz], [one.p[0], one.p[1], one.v[0], one.q[3], one.c[2]], rtol=1e-6, atol=1e-7)
        off.append(math.hypot(one.p[0] - way[user, round(t, 3)][0], one.p[1] - way[user, round(t, 3)][1]))
    assert max(off) < 15 and len(off) == 4


def running(rows, **limits):
    """Running sums of x by session in order of t, and how many sessions the stack was made for."""

    class Sums:
        def __init__(self, n):
            self.sum, self.made = np.zeros(n), n

        def keep(self, on):
            self.sum = self.sum[on]

        def step(self, wave):
            self.sum = self.sum + wave["x"].to_numpy()
            return np.arange(len(self.sum)), {"t": wave["t"].to_numpy(), "sum": self.sum, "made": np.full(len(self.sum), self.made)}

    return stacked.together(rows, "s", [F.col("t")], ["t", "x"], Sums, "t long, sum double, made long", **limits)


def test_a_partition_of_many_sessions_is_not_one_stack(spark):
    """What a task holds does not grow with the sessions that Spark deals to it."""
    rows = spark.range(9000).select((F.col("id") % 3000).alias("s"), F.col("id").alias("t"), F.lit(1.0).alias("x")).coalesce(1)
    got = running(rows).collect()
    assert len(got) == 9000 and all(r["sum"] == r.t // 3000 + 1 for r in got)
    assert max(r.made for r in got) <= 1024


@pytest.mark.parametrize("limits", [{"block": 1}, {"block": 7, "wide": 3}, {"block": 40}, {"wide": 1}, {}])
def test_blocks_of_sessions_change_nothing(spark, limits):
    draw = np.random.default_rng(5)
    given = [(None if s == 0 else s, t, float(draw.integers(9))) for s in range(25) for t in range(int(draw.choice([1, 2, 30])))]
    rows = spark.createDataFrame([given[i] for i in draw.permutation(len(given))], "s int, t long, x double")
    for dealt in (rows.coalesce(1), rows.repartition(5)):
        got = running(dealt, **limits)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 1
        sums = {}
        want = [(s, t, sums.setdefault(s, []).append(x) or sum(sums[s])) for s, t, x in given]
        found = got.collect()
        assert sorted(map(str, want)) == sorted(str((r.s, r.t, r["sum"])) for r in found)
        assert all(r.made <= min(limits.get("block", 25), limits.get("wide", 25)) for r in found)
