"""Inertial navigation: strapdown propagation, and a filter of its errors in fifteen states.

The nominal state (position and velocity east-north-up from an anchor, attitude, gyro and accelerometer bias)
is propagated by samples; the filter keeps the covariance of its error: position, velocity, a rotation
vector in the navigation frame, and both biases. A measurement is at most three linear rows; it is tested whole and
taken whole, in the Joseph form, and its correction goes into the nominal state at once.

All sessions of a partition, and all arms (settings that run side by side over one reading of the
rows), are stepped together as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.geodesy import EARTH_RATE, GRAVITY_EQUATOR, GRAVITY_K, OMEGA2A3_GM, WGS84_A, WGS84_E2, WGS84_F
from driftline.operators.sequential import last_nulls
from driftline.operators.stacked import padded, together

#: What a row can be, with the values (z) and variances (r) that it carries.
#: align: vx vy vz, attitude w x y z, latitude, longitude (degrees), height | position, velocity, attitude, gyro bias, accelerometer bias
#: sample: specific force x y z, turn rate x y z |
#: position: east, north and perhaps up | one for each
#: velocity: speed, course (radians) | one       speed: speed | one       still: | one
#: sideways: device-from-vehicle w x y z | lateral, vertical              forward: speed, device-from-vehicle | one
#: heading: residual (measured less own yaw error, counted clockwise) | one
#: cross: unit normal east, north, residual | one                         inflate: attitude variance to add |
KINDS = ("align", "sample", "position", "velocity", "speed", "still", "sideways", "forward", "heading", "cross", "inflate")
#: Measurements whose refusals end a run if they go on too long; the others are constraints.
FIXES = ("position", "velocity", "speed")
#: Chi-square at 0.999 for one, two and three rows: fixed values.
GATE = np.array([np.inf, 10.8276, 13.8155, 16.2662])
POS, VEL, ATT, GYRO, ACC = (slice(3 * i, 3 * i + 3) for i in range(5))


@dataclass(frozen=True)
class Arm:
    """One setting of the filter: its name, the kinds of rows that it does not use, noise densities and limits (seconds)."""

    name: str = "all"
    off: tuple[str, ...] = ()
    accel_noise: float = 0.05
    gyro_noise: float = 0.005
    accel_walk: float = 1e-4
    gyro_walk: float = 1e-5
    longest_step: float = 0.2
    longest_gap: float = 5.0
    rejected_for: float = 30.0
    rejected_gap: float = 5.0
    least_speed: float = 1.0


def turn(r: np.ndarray) -> np.ndarray:
    """Quaternions of rotation vectors."""
    a = np.linalg.norm(r, axis=1, keepdims=True)
    s = np.where(a < 1e-8, 0.5 - a * a / 48, np.sin(a / 2) / np.where(a < 1e-8, 1, a))
    return np.concatenate([np.cos(a / 2), s * r], axis=1)


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Hamilton products of quaternions, row by row."""
    w = p[:, 0] * q[:, 0] - (p[:, 1:] * q[:, 1:]).sum(axis=1)
    v = p[:, :1] * q[:, 1:] + q[:, :1] * p[:, 1:] + np.cross(p[:, 1:], q[:, 1:])
    return np.concatenate([w[:, None], v], axis=1)


def matrices(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return np.moveaxis(np.array(m), 2, 0)


def skew(v: np.ndarray) -> np.ndarray:
    o = np.zeros(len(v))
    x, y, z = v.T
    return np.moveaxis(np.array([[o, -z, y], [z, o, -x], [-y, x, o]]), 2, 0)


def unit(q: np.ndarray) -> np.ndarray:
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def earth(lat: np.ndarray, height: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Earth rate and transport rate (ENU, rad/s) and gravity (m/s^2, downwards) at latitudes in radians."""
    s2, o = np.sin(lat) ** 2, np.zeros(len(lat))
    w = 1 - WGS84_E2 * s2
    n, m = WGS84_A / np.sqrt(w), WGS84_A * (1 - WGS84_E2) / w**1.5
    rate = np.stack([o, EARTH_RATE * np.cos(lat), EARTH_RATE * np.sin(lat)], axis=1)
    transport = np.stack([-v[:, 1] / (m + height), v[:, 0] / (n + height), v[:, 0] * np.tan(lat) / (n + height)], axis=1)
    free_air = 1 - 2 / WGS84_A * (1 + WGS84_F + OMEGA2A3_GM - 2 * WGS84_F * s2) * height + 3 / WGS84_A**2 * height * height
    return rate, transport, GRAVITY_EQUATOR * (1 + GRAVITY_K * s2) / np.sqrt(w) * free_air


#: How gravity weakens with height, 1/s^2: a fixed value.
GRADIENT = 3.086e-6


class Navigation:
    """States of ``n`` sessions under each of the arms; the arms of a session stand together."""

    def __init__(self, n: int, arms: tuple[Arm, ...], covariance: bool, samples: bool) -> None:
        self.arms, self.covariance, self.samples = arms, covariance, samples
        self.arm = np.tile(np.arange(len(arms)), n)
        setting = lambda f: np.array([f(a) for a in arms], float)[self.arm]
        self.set = {k: setting(lambda a, k=k: getattr(a, k)) for k in ("accel_noise", "gyro_noise", "accel_walk", "gyro_walk", "longest_step", "longest_gap", "rejected_for", "rejected_gap", "least_speed")}
        self.uses = np.array([[k not in a.off for k in KINDS] for a in arms])[self.arm]
        m = len(self.arm)
        self.on, self.failed, self.moved = (np.zeros(m, bool) for _ in range(3))
        self.t, self.span, self.tried = np.zeros(m), np.zeros(m), np.full(m, np.nan)
        self.anchor, self.p, self.v, self.bg, self.ba, self.last = (np.zeros((m, 3)) for _ in range(6))
        self.q = np.tile([1.0, 0, 0, 0], (m, 1))
        self.cov = np.zeros((m, 15, 15)) if covariance else np.zeros((m, 0, 0))

    def keep(self, on: np.ndarray) -> None:
        on = np.repeat(on, len(self.arms))
        self.set = {k: x[on] for k, x in self.set.items()}
        for name in ("arm", "uses", "on", "failed", "moved", "t", "span", "tried", "anchor", "p", "v", "bg", "ba", "last", "q", "cov"):
            setattr(self, name, getattr(self, name)[on])

    def step(self, rows: pa.Table) -> tuple[np.ndarray, dict]:
        a = len(self.arms)
        code = pc.index_in(rows["kind"], value_set=pa.array(KINDS)).to_numpy(zero_copy_only=False)
        own = np.repeat(np.nan_to_num(np.asarray(code, float), nan=-1).astype(np.int64), a)
        t, z, r = np.repeat(rows["t"].to_numpy().astype(float), a), np.repeat(padded(rows["z"], 10), a, axis=0), np.repeat(padded(rows["r"], 5), a, axis=0)
        outcome, nis = np.full(len(own), "unknown", object), np.full(len(own), np.nan)
        with np.errstate(all="ignore"):
            used = self.uses[np.arange(len(own)), own] & (own >= 0)
            outcome[(own >= 0) & ~used] = "off"
            of = lambda kind: np.flatnonzero(used & (own == KINDS.index(kind)))
            self._align(of("align"), t, z, r, outcome)
            rest = used & (own > 0)
            outcome[rest & ~self.on] = "unaligned"
            outcome[rest & self.on & self.failed] = "failed"
            used &= ~rest | (self.on & ~self.failed)
            self._propagate(of("sample"), t, z, outcome)
            if self.covariance:
                self._inflate(of("inflate"), z, outcome)
                self._measure(np.flatnonzero(used & (own > 1) & (own < 10)), own, t, z, r, outcome, nis)
        show = np.flatnonzero((own != 1) | self.samples)
        spread = lambda *i: np.sqrt(sum(self.cov[show, k, k] for k in i)) if self.covariance else np.full(len(show), np.nan)
        names = pa.array([x.name for x in self.arms])
        flat = {f"{n}{c}": x[show, k] for n, x in (("p", self.p), ("v", self.v), ("bg", self.bg), ("ba", self.ba)) for k, c in enumerate("xyz")} | {f"q{c}": self.q[show, k] for k, c in enumerate("wxyz")}
        return show // a, {
            "t": t[show], "kind": rows["kind"].take(pa.array(show // a)).combine_chunks(), "arm": names.take(pa.array(self.arm[show])), "outcome": pa.array(outcome[show], pa.string()), "nis": nis[show],
            **flat, "sigma_p": spread(0, 1), "sigma_v": spread(3, 4), "sigma_yaw": spread(8),
        }

    def _align(self, i: np.ndarray, t: np.ndarray, z: np.ndarray, r: np.ndarray, outcome: np.ndarray) -> None:
        good = np.isfinite(z[i]).all(axis=1) & np.isfinite(r[i]).all(axis=1) & (r[i] > 0).all(axis=1) & (np.abs(z[i, 3:7]).sum(axis=1) > 0) & (t[i] >= 0)
        outcome[i] = np.where(good, "aligned", "invalid")
        i = i[good]
        self.on[i], self.failed[i], self.moved[i], self.t[i], self.span[i], self.tried[i] = True, False, False, t[i], 0, np.nan
        self.anchor[i], self.p[i], self.v[i], self.q[i], self.bg[i], self.ba[i], self.last[i] = z[i, 7:10], 0, z[i, :3], unit(z[i, 3:7]), 0, 0, 0
        if self.covariance:
            self.cov[i] = np.repeat(r[i], 3, axis=1)[:, :, None] * np.eye(15)

    def _noise(self, i: np.ndarray, dt: np.ndarray) -> np.ndarray:
        q, d = np.zeros((len(i), 15, 15)), np.arange(3)
        accel, gyro = self.set["accel_noise"][i] ** 2, self.set["gyro_noise"][i] ** 2
        for rows, cols, x in ((POS, POS, accel * dt**3 / 3), (POS, VEL, accel * dt**2 / 2), (VEL, POS, accel * dt**2 / 2), (VEL, VEL, accel * dt), (ATT, ATT, gyro * dt), (GYRO, GYRO, self.set["gyro_walk"][i] ** 2 * dt), (ACC, ACC, self.set["accel_walk"][i] ** 2 * dt)):
            q[:, rows.start + d, cols.start + d] = x[:, None]
        return q

    def _propagate(self, i: np.ndarray, t: np.ndarray, z: np.ndarray, outcome: np.ndarray) -> None:
        dt = t[i] - self.t[i]
        finite, small = np.isfinite(z[i, :6]).all(axis=1) & np.isfinite(dt), dt < 1e-9
        broken, held = finite & (dt > self.set["longest_gap"][i]), finite & (dt > self.set["longest_step"][i]) & (dt <= self.set["longest_gap"][i])
        outcome[i] = np.select([~finite, dt < 0, small, broken, held], ["not_finite", "backwards", "duplicate", "gap", "held"], "propagated")
        self.failed[i[~finite | broken]] = True
        if self.covariance:
            self.cov[i[held]] += self._noise(i[held], dt[held])
        self.t[i[held]] = t[i[held]]
        go = finite & ~small & ~broken & ~held
        i, dt = i[go], dt[go, None]
        if not len(i):
            return
        v, anchor = self.v[i], self.anchor[i]
        lat0 = np.radians(anchor[:, 0])
        meridian = WGS84_A * (1 - WGS84_E2) / (1 - WGS84_E2 * np.sin(lat0) ** 2) ** 1.5
        rate, transport, g = earth(lat0 + self.p[i, 1] / (meridian + anchor[:, 2]), anchor[:, 2] + self.p[i, 2], v)
        nav, frame = rate + transport, 2 * rate + transport
        q = unit(product(product(turn(-nav * dt), self.q[i]), turn((z[i, 3:6] - self.bg[i]) * dt)))
        c = matrices(q)
        force = np.einsum("nij,nj->ni", c, z[i, :3] - self.ba[i])
        acc = force - np.cross(frame, v)
        acc[:, 2] -= g
        after = v + np.where(self.moved[i, None], (self.last[i] + acc) / 2, acc) * dt
        place = self.p[i] + (v + after) / 2 * dt
        good = np.isfinite(np.concatenate([q, after, place], axis=1)).all(axis=1)
        if self.covariance:
            f = np.zeros((len(i), 15, 15))
            f[:, POS, VEL], f[:, VEL, VEL], f[:, VEL, ATT], f[:, VEL, ACC] = np.eye(3), -skew(frame), -skew(force), -c
            f[:, 5, 2], f[:, ATT, ATT], f[:, ATT, GYRO] = GRADIENT, -skew(nav), -c
            phi = np.eye(15) + f * dt[:, :, None]
            cov = phi @ self.cov[i] @ phi.transpose(0, 2, 1) + self._noise(i, dt[:, 0])
            cov = (cov + cov.transpose(0, 2, 1)) / 2
            good &= self._sound(cov)
            self.cov[i[good]] = cov[good]
        outcome[i[~good]], self.failed[i[~good]] = "numerical", True
        i, k = i[good], good
        self.q[i], self.v[i], self.p[i], self.last[i], self.moved[i], self.t[i] = q[k], after[k], place[k], acc[k], True, t[i]

    @staticmethod
    def _sound(cov: np.ndarray) -> np.ndarray:
        return np.isfinite(cov).all(axis=(1, 2)) & (np.diagonal(cov, axis1=1, axis2=2) > 0).all(axis=1)

    def _inflate(self, i: np.ndarray, z: np.ndarray, outcome: np.ndarray) -> None:
        good = np.isfinite(z[i, 0]) & (z[i, 0] > 0)
        outcome[i] = np.where(good, "inflated", "invalid")
        for d in range(6, 9):
            self.cov[i[good], d, d] += z[i[good], 0]

    def _rows(self, i: np.ndarray, own: np.ndarray, z: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, residuals, variances, number of rows, and whether they can be built."""
        n = len(i)
        h, y, var, size, ok = np.zeros((n, 3, 15)), np.zeros((n, 3)), np.ones((n, 3)), np.ones(n, np.int64), np.ones(n, bool)
        at = lambda kind: np.flatnonzero(own[i] == KINDS.index(kind))
        for kind in sorted({KINDS[c] for c in np.unique(own[i])}):
            k = at(kind)
            j, v = i[k], self.v[i[k]]
            zk, rk = z[j], r[j]
            if kind == "position":
                third = np.isfinite(zk[:, 2]) & np.isfinite(rk[:, 2]) & (rk[:, 2] > 0)
                size[k] = 2 + third
                h[k, 0, 0] = h[k, 1, 1] = 1
                h[k[third], 2, 2] = 1
                y[k, :2], y[k[third], 2] = zk[:, :2] - self.p[j, :2], (zk[:, 2] - self.p[j, 2])[third]
                var[k, :2], var[k[third], 2] = rk[:, :2], rk[third, 2]
            elif kind == "velocity":
                size[k] = 2
                h[k, 0, 3] = h[k, 1, 4] = 1
                y[k, :2], var[k, :2] = zk[:, :1] * np.stack([np.sin(zk[:, 1]), np.cos(zk[:, 1])], axis=1) - v[:, :2], rk[:, :1]
            elif kind == "speed":
                flat = np.hypot(v[:, 0], v[:, 1])
                ok[k] = flat >= self.set["least_speed"][j]
                h[k, 0, 3:5] = v[:, :2] / np.where(ok[k], flat, 1)[:, None]
                y[k, 0], var[k, 0] = zk[:, 0] - flat, rk[:, 0]
            elif kind == "still":
                size[k] = 3
                h[k, :, VEL] = np.eye(3)
                y[k], var[k] = -v, rk[:, :1]
            elif kind in ("sideways", "forward"):
                first = int(kind == "forward")
                axes = matrices(product(self.q[j], unit(zk[:, first : first + 4])))
                for row, axis in enumerate((0,) if first else (1, 2)):
                    h[k, row, VEL] = axes[:, :, axis]
                    y[k, row] = (zk[:, 0] if first else 0) - (axes[:, :, axis] * v).sum(axis=1)
                    var[k, row] = rk[:, row]
                size[k] = 2 - first
            elif kind == "heading":
                h[k, 0, 8], y[k, 0], var[k, 0] = -1, zk[:, 0], rk[:, 0]
            else:
                ok[k] = np.abs(np.hypot(zk[:, 0], zk[:, 1]) - 1) <= 1e-6
                h[k, 0, :2], y[k, 0], var[k, 0] = zk[:, :2], zk[:, 2], rk[:, 0]
        ok &= np.isfinite(y).all(axis=1) & np.isfinite(var).all(axis=1) & (var > 0).all(axis=1) & np.isfinite(h).all(axis=(1, 2))
        return h, y, var, size, ok

    def _measure(self, i: np.ndarray, own: np.ndarray, t: np.ndarray, z: np.ndarray, r: np.ndarray, outcome: np.ndarray, nis: np.ndarray) -> None:
        if not len(i):
            return
        h, y, var, size, ok = self._rows(i, own, z, r)
        outcome[i[~ok]] = "invalid"
        i, h, y, var, size = i[ok], h[ok], y[ok], var[ok], size[ok]
        across = self.cov[i] @ h.transpose(0, 2, 1)
        s = h @ across + var[:, :, None] * np.eye(3)
        inverse = np.linalg.inv(s)
        test = np.einsum("ni,nij,nj->n", y, inverse, y)
        nis[i] = test
        fix = np.isin(own[i], [KINDS.index(k) for k in FIXES])
        taken, bad = test <= GATE[size], ~np.isfinite(test)
        outcome[i] = np.select([bad, taken], ["ill_conditioned", "accepted"], "gate")
        self.span[i[taken & (own[i] == KINDS.index("position"))]] = 0
        self._refused(i[fix & ~taken & ~bad], t, outcome)
        i, h, y, var, across, inverse = i[taken], h[taken], y[taken], var[taken], across[taken], inverse[taken]
        gain = across @ inverse
        rest = np.eye(15) - gain @ h
        cov = rest @ self.cov[i] @ rest.transpose(0, 2, 1) + (gain * var[:, None, :]) @ gain.transpose(0, 2, 1)
        cov = (cov + cov.transpose(0, 2, 1)) / 2
        x = np.einsum("nij,nj->ni", gain, y)
        good = self._sound(cov) & np.isfinite(x).all(axis=1)
        outcome[i[~good]], self.failed[i[~good]] = "numerical", True
        i, x = i[good], x[good]
        self.cov[i] = cov[good]
        self.p[i], self.v[i], self.bg[i], self.ba[i] = self.p[i] + x[:, POS], self.v[i] + x[:, VEL], self.bg[i] + x[:, GYRO], self.ba[i] + x[:, ACC]
        self.q[i] = unit(product(turn(x[:, ATT]), self.q[i]))

    def _refused(self, i: np.ndarray, t: np.ndarray, outcome: np.ndarray) -> None:
        """A run ends when fixes have been refused, without long breaks, for too long."""
        gap = np.nan_to_num(t[i] - self.tried[i])
        self.span[i] = np.where(gap <= self.set["rejected_gap"][i], self.span[i] + gap, 0)
        self.tried[i] = t[i]
        over = i[self.span[i] > self.set["rejected_for"][i]]
        outcome[over], self.failed[over] = "rejected_too_long", True


_STATE = ", ".join(f"{n}{c} double" for n in ("p", "v", "bg", "ba") for c in "xyz") + ", " + ", ".join(f"q{c} double" for c in "wxyz")
SCHEMA = f"t double, kind string, arm string, outcome string, nis double, {_STATE}, sigma_p double, sigma_v double, sigma_yaw double"


def navigated(rows: DataFrame, session: str, *, arms: tuple[Arm, ...] = (Arm(),), covariance: bool = True, samples: bool = False) -> DataFrame:
    """A row for each row of ``rows`` and arm: what became of it, its test value, the state after it and its spread.

    ``rows`` are (session, t, kind, z, r), see :data:`KINDS`; rows of one time come in order of kind (align, sample, then
    measurements). Samples are shown only if ``samples``. Without ``covariance`` measurements are passed over (``unknown``): plain
    propagation. A kind that is not known, a null kind and a row that an arm does not use change nothing.
    """
    columns = ["t", "kind", "z", "r"]
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0))
    given = rows.select(session, F.col("t").cast("double").alias("t"), "kind", F.col("z").cast("array<double>").alias("z"), F.col("r").cast("array<double>").alias("r"))
    return together(given, session, [F.col("t").asc_nulls_last(), rank, *last_nulls("z", "r")], columns, lambda n: Navigation(n, arms, covariance, samples), SCHEMA)
