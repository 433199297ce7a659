"""Steps that need the step before: propagation, filters, matching, planning.

Spark spreads the sessions (drives) and sorts each by time; numpy takes the
steps. A task holds a batch of rows and the small state of one session, so a
session may be of any length; :func:`planned` alone gathers a session's
candidate times in one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[pd.DataFrame], tuple[np.ndarray, dict]]


def stepped(rows: DataFrame, session: str, order: list[Column], columns: list[str], start: Callable[[], Step], schema: str) -> DataFrame:
    """The ``columns`` of each session's rows, in ``order``, through a step that keeps its state from batch to batch.

    ``start`` makes the step of a session. It takes the session's next rows and
    gives the places among them that it has output for, and the output's columns. Sorting is the
    window's; a null session is a session. ``schema`` has the output's columns after the session.
    """
    first = F.row_number().over(Window.partitionBy(session).orderBy(*order)) == 1
    flagged = rows.select(F.col(session).alias("session"), first.alias("first"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for b in batches:
            new = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.unique(np.r_[0, np.flatnonzero(new), b.num_rows])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if new[i]:
                    step = start()
                part = b.slice(i, j - i)
                at, out = step(part.select(columns).to_pandas())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, from_pandas=True) for x in out.values())], [session, *out])

    return flagged.mapInArrow(run, f"{session} {dict(rows.dtypes)[session]}, {schema}")


def last_nulls(*names: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in names]


def planned(rows: DataFrame, keys: list[str], t: str, candidate: Column, length: int, recovery: int) -> DataFrame:
    """Non-overlapping intervals, greedily from the earliest: start, end.

    The fold over a session's candidate times stays in the JVM: an interval
    starts at a candidate that is not before the last end and its recovery.
    """
    times = rows.filter(candidate).groupBy(*keys).agg(F.sort_array(F.collect_list(t)).alias("_t"))

    def step(s: Column, x: Column) -> Column:
        free = (F.size(s) == 0) | (x >= F.element_at(s, -1) + length + recovery)
        return F.when(free, F.concat(s, F.array(x))).otherwise(s)

    return times.select(*keys, F.explode(F.aggregate("_t", F.array().cast("array<long>"), step)).alias("start")).withColumn("end", F.col("start") + length)


def propagated(rows: DataFrame, session: str) -> DataFrame:
    """Strapdown propagation of (t, fx, fy, fz, wx, wy, wz): attitude quaternion, velocity and position in a local level frame.

    Constant gravity, first-order gap hold: a step over ``1 s`` keeps the
    attitude's rate and skips the specific force.
    """

    names = ["qw", "qx", "qy", "qz", "vx", "vy", "vz", "px", "py", "pz"]
    columns = ["t", "fx", "fy", "fz", "wx", "wy", "wz"]

    def start() -> Step:
        q, v, p, last = np.array([1.0, 0, 0, 0]), np.zeros(3), np.zeros(3), None

        def step(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
            nonlocal q, v, p, last
            t = pdf["t"].to_numpy()
            f, w = pdf[["fx", "fy", "fz"]].to_numpy(), pdf[["wx", "wy", "wz"]].to_numpy()
            out = np.zeros((len(t), 10))
            for i in range(len(t)):
                dt = 0.0 if last is None else t[i] - last
                last = t[i]
                if dt > 0:
                    r = w[i] * dt
                    a = np.linalg.norm(r)
                    d = np.r_[np.cos(a / 2), (np.sin(a / 2) / a if a > 1e-12 else 0.5) * r]
                    q = multiplied(q, d)
                    q /= np.linalg.norm(q)
                    acc = matrix(q) @ f[i] - np.array([0, 0, 9.80665]) if dt <= 1.0 else np.zeros(3)
                    p = p + v * dt + 0.5 * acc * dt * dt
                    v = v + acc * dt
                out[i] = np.r_[q, v, p]
            return np.arange(len(t)), {"t": t, **{c: out[:, k] for k, c in enumerate(names)}}

        return step

    return stepped(rows, session, last_nulls(*columns), columns, start, "t double, " + ", ".join(f"{c} double" for c in names))


def multiplied(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    w, v = p[0] * q[0] - p[1:] @ q[1:], p[0] * q[1:] + q[0] * p[1:] + np.cross(p[1:], q[1:])
    return np.r_[w, v]


def matrix(q: np.ndarray) -> np.ndarray:
    w, u = q[0], q[1:]
    cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return np.eye(3) + 2 * w * cross + 2 * cross @ cross


#: Chi-square at 0.99 for one, two and three rows: fixed values.
GATE = {1: 6.635, 2: 9.210, 3: 11.345}


class Kalman:
    """A gated linear filter with the Joseph form: an update is taken whole or not at all."""

    def __init__(self, x: np.ndarray, p: np.ndarray) -> None:
        self.x, self.p = x.astype(float), p.astype(float)

    def predict(self, f: np.ndarray, q: np.ndarray) -> None:
        self.x, self.p = f @ self.x, f @ self.p @ f.T + q

    def update(self, z: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[bool, float]:
        """(taken, normalised innovation squared)."""
        y, s = z - h @ self.x, h @ self.p @ h.T + r
        nis = float(y @ np.linalg.solve(s, y))
        if nis > GATE[len(z)]:
            return False, nis
        k = np.linalg.solve(s, h @ self.p).T
        i = np.eye(len(self.x)) - k @ h
        self.x, self.p = self.x + k @ y, i @ self.p @ i.T + k @ r @ k.T
        return True, nis


def filtered(rows: DataFrame, session: str, *, accel: float = 1.5, fix_m: float = 5.0, speed: float = 0.5) -> DataFrame:
    """East-north position and velocity from fixes, speeds along a heading, and standstills.

    Rows are (t, kind, east, north, speed, heading): kind ``fix`` updates the position,
    ``speed`` the forward and the sideways velocity (no side slip), ``stop`` both velocities with zero. Refused
    updates are kept with their test value, never dropped.
    """

    columns = ["t", "kind", "east", "north", "speed", "heading"]

    def start() -> Step:
        k, last = None, None

        def step(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
            nonlocal k, last
            states, accepted, tests = np.full((len(pdf), 5), np.nan), np.zeros(len(pdf), bool), np.full(len(pdf), np.nan)
            for i, (t, kind, east, north, v, heading) in enumerate(pdf[columns].itertuples(index=False)):
                taken, nis = False, np.nan
                if k is None:
                    if kind == "fix":
                        k = Kalman(np.array([east, north, 0, 0]), np.diag([fix_m**2, fix_m**2, 25.0, 25.0]))
                        taken = True
                else:
                    dt = t - last
                    f = np.eye(4)
                    f[0, 2] = f[1, 3] = dt
                    g = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
                    k.predict(f, g @ g.T * accel**2)
                    if kind == "fix":
                        taken, nis = k.update(np.array([east, north]), np.eye(2, 4), np.eye(2) * fix_m**2)
                    elif kind == "speed":
                        s, c = np.sin(heading), np.cos(heading)
                        taken, nis = k.update(np.array([v, 0.0]), np.array([[0, 0, s, c], [0, 0, c, -s]]), np.diag([speed**2, (2 * speed) ** 2]))
                    elif kind == "stop":
                        taken, nis = k.update(np.zeros(2), np.eye(2, 4, 2), np.eye(2) * 0.01)
                accepted[i], tests[i] = taken, nis
                if k is not None:
                    last = t
                    states[i] = np.r_[k.x, np.sqrt((k.p[0, 0] + k.p[1, 1]) / 2)]
            out = {c: states[:, n] for n, c in enumerate(("east", "north", "v_east", "v_north", "sigma"))}
            return np.arange(len(pdf)), {"t": pdf["t"].to_numpy(), "kind": pa.array(pdf["kind"], pa.string(), from_pandas=True), **out, "taken": accepted, "nis": tests}

        return step

    return stepped(rows, session, last_nulls(*columns), columns, start, "t double, kind string, east double, north double, v_east double, v_north double, sigma double, taken boolean, nis double")


def viterbi(candidates: DataFrame, session: str, *, fix: str | None = None, beta_m: float = 30.0, jump: float = -12.0) -> DataFrame:
    """The likeliest segment at each time of a session: (t, segment, confidence).

    Rows are (t, segment, u, v, log_emission, travelled_m, along_m). Going on along a segment or
    to one that shares a node costs by how far the way along the road differs from what
    was travelled; any other change costs ``jump``. The confidence is the forward share of the chosen one.
    ``fix`` names a column (long) that tells fixes of one time apart and orders them: each is a step of its own.
    """

    fields = ["segment", "u", "v", "log_emission", "travelled_m", "along_m"]
    # the candidates of one fix are few: one row for each fix
    steps = candidates.groupBy(session, "t", (F.col(fix) if fix else F.lit(0)).cast("long").alias("fix")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c")).select(session, "t", "fix", *[F.col(f"c.{x}").alias(x) for x in fields])

    def onward() -> Step:
        before, score, forward = None, None, None

        def step(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
            nonlocal before, score, forward
            backs, shares, best = [], [], np.zeros(len(pdf), np.int64)
            for i, now in enumerate(pdf[fields].itertuples(index=False)):
                segment, u, v, e, travelled, along = (np.asarray(x) for x in now)
                if before is None:
                    score, forward, back = e.copy(), e.copy(), np.zeros(len(e), np.int64)
                else:
                    old_segment, old_u, old_v, old_along = before
                    same = old_segment[:, None] == segment[None, :]
                    touch = np.zeros_like(same)
                    for a in (old_u, old_v):
                        for b in (u, v):
                            touch |= a[:, None] == b[None, :]
                    way = np.abs(along[None, :] - old_along[:, None])
                    move = np.where(same, -np.abs(way - travelled[None, :]) / beta_m, np.where(touch, -1.0, jump))
                    total = score[:, None] + move
                    back = total.argmax(axis=0)
                    score = total.max(axis=0) + e
                    f = forward[:, None] + move
                    top = f.max(axis=0)
                    forward = top + np.log(np.exp(f - top).sum(axis=0)) + e
                before = segment, u, v, along
                x = np.exp(forward - forward.max())
                backs.append(back.tolist())
                shares.append((x / x.sum()).tolist())
                best[i] = score.argmax()
            out = {"t": pdf["t"].to_numpy(), "fix": pdf["fix"].to_numpy(), "segment": pa.array(pdf["segment"], pa.list_(pa.int64())), "back": pa.array(backs, pa.list_(pa.int64())), "share": pa.array(shares, pa.list_(pa.float64())), "best": best}
            return np.arange(len(pdf)), out

        return step

    def backward() -> Step:
        at = None

        def step(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
            nonlocal at
            segments, confidence = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for i, (segment, back, share, best) in enumerate(pdf[["segment", "back", "share", "best"]].itertuples(index=False)):
                at = best if at is None else at
                segments[i], confidence[i], at = segment[at], share[at], back[at]
            return np.arange(len(pdf)), {"t": pdf["t"].to_numpy(), "segment": segments, "confidence": confidence}

        return step

    trellis = stepped(steps, session, last_nulls("t", "fix"), ["t", "fix", *fields], onward, "t double, fix long, segment array<long>, back array<long>, share array<double>, best long")
    return stepped(trellis, session, [F.col("t").desc_nulls_first(), F.col("fix").desc_nulls_first()], ["t", "segment", "back", "share", "best"], backward, "t double, segment long, confidence double")


def solved(rows: DataFrame, keys: list[str], x: list[str], y: str, *, condition: float = 1e6) -> DataFrame:
    """Least squares of y on the columns x of each key; nulls where the normal matrix is ill-conditioned.

    The moments are aggregates that Spark combines before the shuffle; only
    one small matrix for each key is solved in numpy.
    """
    n = len(x)
    moments = [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.col(c) * F.col(y)).alias(f"r{i}") for i, c in enumerate(x)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *moments)

    def run(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            m = np.zeros((len(pdf), n, n))
            for i in range(n):
                for j in range(i, n):
                    m[:, i, j] = m[:, j, i] = pdf[f"m{i}_{j}"]
            r = pdf[[f"r{i}" for i in range(n)]].to_numpy()
            ok = (np.linalg.cond(m) < condition) if len(pdf) else np.zeros(0, bool)
            beta = np.full((len(pdf), n), np.nan)
            beta[ok] = np.linalg.solve(m[ok], r[ok][:, :, None])[:, :, 0]
            out = pdf[[*keys, "n"]].copy()
            for i, c in enumerate(x):
                out["b_" + c] = pd.Series(beta[:, i], index=out.index).astype(object).where(ok, None)
            yield out

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}, n long, " + ", ".join(f"b_{c} double" for c in x))


def slips(rows: DataFrame, session: str, *, tau: float = 2.0, angle: float = 0.35, dwell: int = 3, cooldown: float = 30.0) -> DataFrame:
    """Times when the smoothed gravity of (t, gx, gy, gz) has left its reference direction for ``dwell`` rows.

    The reference becomes the new direction then, and nothing is reported within ``cooldown`` after.
    """

    columns = ["t", "gx", "gy", "gz"]

    def start() -> Step:
        g = ref = None
        held, quiet, last = 0, -np.inf, 0.0

        def step(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
            nonlocal g, ref, held, quiet, last
            at, times, angles = [], [], []
            for i, (t, x, y, z) in enumerate(pdf[columns].itertuples(index=False)):
                v = np.array([x, y, z])
                g = v if g is None else g + (v - g) * (1 - np.exp(-(t - last) / tau))
                last, ref = t, g if ref is None else ref
                off = np.arccos(np.clip(g @ ref / max(np.linalg.norm(g) * np.linalg.norm(ref), 1e-12), -1, 1))
                held = held + 1 if off > angle else 0
                if held >= dwell and t >= quiet:
                    at.append(i), times.append(t), angles.append(float(off))
                    ref, held, quiet = g, 0, t + cooldown
            return np.array(at, np.int64), {"t": np.array(times, float), "angle": np.array(angles, float)}

        return step

    return stepped(rows, session, last_nulls(*columns), columns, start, "t double, angle double")
