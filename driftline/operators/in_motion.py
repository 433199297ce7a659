"""A mount learned while driving: straight segments give yaws, a state for each session gathers and checks them.

Segments are runs of moving fixes; what is known of one is a set of aggregates over its fixes and samples, and one code says
whether it tells where forward is. The state machine sees few rows for a session (rests, segments, handling) and
all sessions of a partition are stepped together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import rotations
from driftline.operators import temporal
from driftline.operators.sequential import last_nulls
from driftline.operators.stacked import together


@dataclass(frozen=True)
class Limits:
    """Metres, seconds, radians a second; angles in degrees."""

    moving: float = 3.0
    parked: float = 1.0
    longest: float = 120.0
    least_fixes: int = 3
    most_accuracy: float = 15.0
    straight_rate: float = 0.03
    straight_share: float = 0.9
    excitation: float = 0.3
    least_speeds: int = 3
    slope: float = 0.2
    ratio_low: float = 0.4
    ratio_high: float = 2.5
    course_spread: float = 10.0
    baseline: float = 30.0
    course_displacement: float = 15.0
    agreement: float = 15.0
    remount_tilt: float = 10.0
    remount_turn: float = 20.0
    handling_rate: float = 0.15
    longest_pair: float = 1.0
    evidence: int = 16
    least_segments: int = 2


def segments(fixes: DataFrame, samples: DataFrame, rests: DataFrame, session: str, limits: Limits | None = None) -> DataFrame:
    """session, segment, t (its end), code and yaw (null unless ``ACCEPTED``) of each run of moving fixes.

    ``fixes`` are (session, t, speed, course in degrees or null, east, north, accuracy or null), ``samples`` (session, t, fx, fy, fz, wx, wy, wz), ``rests``
    (session, t, ux, uy, uz: which way is up in device axes). A run is cut every ``longest`` seconds. The first code that applies is given.
    """
    m = limits or Limits()
    w = Window.partitionBy(session).orderBy("t")
    on = F.coalesce(F.col("speed") >= m.moving, F.lit(False))
    runs = fixes.withColumn("on", on).withColumn("run", F.sum(F.when(F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("on")
    part = F.floor((F.col("t") - F.min("t").over(Window.partitionBy(session, "run"))) / m.longest)
    own = Window.partitionBy(session, "run", "part").orderBy("t")
    runs = runs.withColumn("part", part).withColumn("first_course", F.first("course", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    spread = F.abs(F.pmod(F.col("course") - F.col("first_course") + 180.0, F.lit(360.0)) - 180.0)
    of_fixes = runs.groupBy(session, "run", "part").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.max("accuracy").alias("worst"), F.count("accuracy").alias("n_accuracy"), F.regr_slope("speed", "t").alias("slope"), F.first("first_course").alias("course"),
        F.max(spread).alias("spread"), *[(F.max_by(c, "t") - F.min_by(c, "t")).alias(c) for c in ("east", "north")],
    )
    known = of_fixes.withColumn("t", F.col("t0"))
    with_up = temporal.asof_join(known, rests.select(session, "t", "ux", "uy", "uz"), [session], "t", prefix="r_").drop("t", "r_t")
    spans = with_up.select(session, "run", "part", F.col("t0").alias("t"), "t1", "r_ux", "r_uy", "r_uz")
    inside = temporal.asof_join(samples, spans, [session], "t", prefix="s_").filter(F.col("t") <= F.col("s_t1"))
    u = [F.col(f"s_r_u{a}") for a in "xyz"]
    size = F.sqrt(sum((c * c for c in u), F.lit(0.0)))
    inside = inside.select("*", *[(c / size).alias(f"u{a}") for c, a in zip(u, "xyz", strict=True)])
    up = sum((F.col(f"f{a}") * F.col(f"u{a}") for a in "xyz"), F.lit(0.0))
    turn = sum((F.col(f"w{a}") * F.col(f"u{a}") for a in "xyz"), F.lit(0.0))
    straight = F.coalesce(F.abs(turn) <= m.straight_rate, F.lit(False))
    of_samples = inside.groupBy(session, F.col("s_run").alias("run"), F.col("s_part").alias("part")).agg(
        F.count("*").alias("n_samples"), F.count_if(straight).alias("n_straight"), *[F.avg(F.when(straight, F.col(f"f{a}") - up * F.col(f"u{a}"))).alias(f"h{a}") for a in "xyz"]
    )
    s = with_up.join(of_samples, [session, "run", "part"], "left").withColumn("force", F.sqrt(F.col("hx") ** 2 + F.col("hy") ** 2 + F.col("hz") ** 2))
    s = s.withColumn("moved", F.hypot("east", "north")).withColumn("bearing", F.degrees(F.atan2("east", "north")))
    ratio, off = F.col("force") / F.abs("slope"), F.abs(F.pmod(F.col("bearing") - F.col("course") + 180.0, F.lit(360.0)) - 180.0)
    code = (
        F.when(F.col("n") < m.least_fixes, "SPARSE").when((F.col("n_accuracy") == 0) | (F.col("worst") > m.most_accuracy), "INACCURATE").when(F.coalesce("n_samples", F.lit(0)) == 0, "NO_SAMPLES")
        .when(F.col("r_ux").isNull(), "NO_TILT").when((F.col("n_straight") == 0) | (F.col("n_straight") / F.col("n_samples") < m.straight_share), "NOT_STRAIGHT").when(F.col("force") < m.excitation, "EXCITATION")
        .when((F.col("n") < m.least_speeds) | F.col("slope").isNull() | (F.abs("slope") < m.slope), "SLOPE").when((ratio < m.ratio_low) | (ratio > m.ratio_high), "MISMATCH")
        .when(F.col("course").isNotNull() & (F.col("spread") > m.course_spread), "COURSE").when(F.col("course").isNotNull() & (F.col("moved") < m.baseline), "BASELINE")
        .when(F.col("course").isNotNull() & (off > m.course_displacement), "DISPLACEMENT").otherwise("ACCEPTED")
    )
    s = s.withColumn("code", code).withColumn("u", F.array("r_ux", "r_uy", "r_uz")).withColumn("h", F.array("hx", "hy", "hz"))
    s = s.withColumn("tilt", F.when(F.col("code") == "ACCEPTED", rotations.shortest_arc(F.col("u"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))))
    s = s.withColumn("planar", rotations.quat_rotate(F.col("tilt"), F.col("h"))).withColumn("sign", F.signum("slope"))
    yaw = -F.atan2(F.col("planar")[1] * F.col("sign"), F.col("planar")[0] * F.col("sign"))
    return s.select(session, F.row_number().over(Window.partitionBy(session).orderBy("t0")).alias("segment"), F.col("t1").alias("t"), "code", yaw.alias("yaw"))


def handling(samples: DataFrame, fixes: DataFrame, session: str, limits: Limits | None = None) -> DataFrame:
    """session, t and turned (radians since the sample before) of samples that turn fast while the last fix says that the vehicle is parked."""
    m = limits or Limits()
    rate = F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2)
    dt = F.col("t") - F.lag("t").over(Window.partitionBy(session).orderBy("t"))
    dt = F.when(dt.isNotNull(), F.least(dt, F.lit(m.longest_pair)))
    rows = samples.select(session, "t", rate.alias("rate"), (rate * dt).alias("turned"))
    with_speed = temporal.asof_join(rows, fixes.filter("speed IS NOT NULL").select(session, "t", "speed"), [session], "t", prefix="f_")
    return with_speed.filter((F.col("rate") >= m.handling_rate) & (F.col("f_speed") <= m.parked) & F.col("turned").isNotNull()).select(session, "t", "turned")


class _States:
    """PENDING, VALID, INVALID or EXPIRED for each session, with the yaws that speak for it."""

    def __init__(self, n: int, limits: Limits) -> None:
        self.limits = limits
        self.status = np.full(n, "PENDING", object)
        self.yaws, self.count = np.zeros((n, limits.evidence)), np.zeros(n, np.int64)
        self.up, self.known, self.turned = np.zeros((n, 3)), np.zeros(n, bool), np.zeros(n)

    def keep(self, on: np.ndarray) -> None:
        for name in ("status", "yaws", "count", "up", "known", "turned"):
            setattr(self, name, getattr(self, name)[on])

    def _cleared(self, i: np.ndarray, status: str) -> None:
        self.status[i], self.count[i], self.turned[i] = status, 0, 0

    def step(self, rows: pa.Table) -> tuple[np.ndarray, dict]:
        m = self.limits
        kind = np.array(rows["kind"].to_pylist(), object)
        x, y, z = (rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "z"))
        n = len(kind)
        event = np.full(n, "", object)
        i = np.flatnonzero(kind == "rest")
        v = np.stack([x, y, z], axis=1)[i]
        with np.errstate(invalid="ignore"):
            cos = (self.up[i] * v).sum(axis=1) / (np.linalg.norm(self.up[i], axis=1) * np.linalg.norm(v, axis=1))
            over = self.known[i] & (np.degrees(np.arccos(np.clip(cos, -1, 1))) > m.remount_tilt)
        self._cleared(i[over], "EXPIRED")
        event[i[over]] = "REMOUNT_TILT"
        fresh = i[over | ~self.known[i]]
        self.up[fresh], self.known[fresh] = np.stack([x, y, z], axis=1)[fresh], True
        i = np.flatnonzero((kind == "turn") & (self.status == "VALID"))
        self.turned[np.flatnonzero((kind == "turn") & (self.status != "VALID"))] = 0
        self.turned[i] += x[i]
        over = i[np.degrees(self.turned[i]) >= m.remount_turn]
        self._cleared(over, "EXPIRED")
        event[over] = "REMOUNT_TURN"
        i = np.flatnonzero((kind == "segment") & np.isfinite(x))
        full = i[self.count[i] == m.evidence]
        self.yaws[full, :-1], self.count[full] = self.yaws[full, 1:], m.evidence - 1
        self.yaws[i, self.count[i]] = x[i]
        self.count[i] += 1
        there = np.arange(m.evidence) < self.count[:, None]
        sin, cos = (np.where(there, f(self.yaws), 0).sum(axis=1) for f in (np.sin, np.cos))
        mean = np.arctan2(sin, cos)
        far = np.where(there, np.abs(np.mod(self.yaws - mean[:, None] + np.pi, 2 * np.pi) - np.pi), 0).max(axis=1)
        against = (np.abs(sin) < 1e-12) & (np.abs(cos) < 1e-12)
        bad = i[against[i] | (np.degrees(far[i]) > m.agreement)]
        good = np.setdiff1d(i, bad)
        event[bad] = np.where(against[bad], "CONTRADICTORY", "INCONSISTENT")
        self._cleared(bad, "INVALID")
        self.status[good] = np.where(self.count[good] >= m.least_segments, "VALID", "PENDING")
        known = self.count > 0
        return np.arange(n), {
            "t": rows["t"].to_numpy(), "kind": pa.array(kind, pa.string()), "event": pa.array(event, pa.string()), "status": pa.array(self.status, pa.string()),
            "yaw": np.where(known, mean, np.nan), "evidence": self.count.astype(np.int32),
        }


def estimated(rests: DataFrame, found: DataFrame, turns: DataFrame, session: str, limits: Limits | None = None) -> DataFrame:
    """session, t, kind, event, status, yaw and evidence after every rest, segment and turn of a session.

    ``found`` is what :func:`segments` gives (those not accepted change nothing), ``turns`` what :func:`handling` gives. Rows of one time come as
    rest, segment, turn.
    """
    m = limits or Limits()
    none = F.lit(None).cast("double")
    rows = rests.select(session, "t", F.lit("rest").alias("kind"), F.col("ux").alias("x"), F.col("uy").alias("y"), F.col("uz").alias("z"))
    rows = rows.union(found.filter("code = 'ACCEPTED'").select(session, "t", F.lit("segment"), "yaw", none, none)).union(turns.select(session, "t", F.lit("turn"), "turned", none, none))
    return together(rows, session, last_nulls("t", "kind", "x", "y", "z"), ["t", "kind", "x", "y", "z"], lambda n: _States(n, m), "t double, kind string, event string, status string, yaw double, evidence int")
