"""Fixes on a road network: a trellis that decides a fix a few steps later, and a greedy match with continuity.

Each fix gets its few nearest segments by one grid join; then all sessions of a partition are stepped
together. A session's state is its last column of candidates and a ring of back-pointers (trellis),
or the last segment it was on (greedy), whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geodesy import WGS84_A, WGS84_E2
from driftline.operators import spatial
from driftline.operators.sequential import last_nulls
from driftline.operators.stacked import padded, together

#: sqrt of chi-square (2) at 0.95: from a 95 % radius to a sigma.
CHI_95 = 5.991**0.5


@dataclass(frozen=True)
class Limits:
    """What both matchers use: metres, radians, metres a second."""

    candidates: int = 8
    least_radius: float = 15.0
    most_radius: float = 60.0
    sigmas: float = 3.0
    most_accuracy: float = 50.0
    floor: float = 5.0
    heading_sigma: float = 0.3490658503988659
    heading_speed: float = 2.0
    margin: float = 0.005


@dataclass(frozen=True)
class Trellis(Limits):
    beta: float = 8.0
    same: float = 1.0
    node: float = 0.7
    way: float = 0.5
    other: float = 0.02
    least_step: float = 5.0
    longest_gap: float = 30.0
    lag: int = 5
    least_confidence: float = 0.6


@dataclass(frozen=True)
class Greedy(Limits):
    least_confidence: float = 0.55
    node: float = 1.5
    way: float = 1.05
    slack: float = 50.0
    horizon: float = 30.0
    usual_speed: float = 30.0


#: What a candidate carries: ids of segment, its nodes and its way, the nearest point, distance and direction.
WHOLE = ("segment", "u", "v", "way")
PARTS = ("near_lat", "near_lon", "distance_m", "heading_rad")
FIX = ("t", "fix", "lat", "lon", "heading", "accuracy", "speed")
#: Rows of cells of a network that still go to every task; about 100 bytes each.
BROADCAST = 100_000


def with_candidates(fixes: DataFrame, segments: DataFrame, session: str, limits: Limits, *, cell: float = 0.002) -> DataFrame:
    """``fixes`` (session, t, fix, lat, lon, heading, accuracy, speed) with the arrays of their nearest segments and whether the network covers them.

    ``segments`` are (segment, u, v, way, lat1, lon1, lat2, lon2), ``fix`` is a number of its own. The left join is on grid cells no smaller
    than the largest radius, and what is out of reach goes in it; ranks and arrays need no further shuffle than the one by fix. A fix has at most
    ``limits.candidates``. The network is broadcast up to ``BROADCAST`` rows of cells, which are counted, since Spark's guess knows nothing of them.
    """
    slack = limits.most_radius / spatial.SPHERE_M * 57.29577951308232 * 1.05
    corners = [f(F.least(a, b) if f is F.min else F.greatest(a, b)) for f in (F.min, F.max) for a, b in (("lat1", "lat2"), ("lon1", "lon2"))]
    *box, stands = segments.agg(*corners, F.sum(spatial.cells_of("lat", cell, slack, F.size) * spatial.cells_of("lon", cell, slack, F.size).cast("long"))).first()
    low = [float("nan") if x is None else x for x in box]
    m = limits.margin
    inside = (F.col("lat") >= low[0] - m) & (F.col("lon") >= low[1] - m) & (F.col("lat") <= low[2] + m) & (F.col("lon") <= low[3] + m)
    inside = F.lit(False) if box[0] is None else F.coalesce(inside, F.lit(False))
    grid = spatial.segment_cells(segments.select("segment", "u", "v", "way", "lat1", "lon1", "lat2", "lon2"), cell, slack)
    grid = grid.withColumnsRenamed({"cell_lat": "grid_lat", "cell_lon": "grid_lon"})
    if (stands or 0) > BROADCAST:
        grid = grid.hint("merge")
    lat, lon = spatial.cells(F.col("lat"), F.col("lon"), cell)
    metres = _metres("lat")
    radius = F.least(F.lit(limits.most_radius), F.greatest(F.lit(limits.least_radius), limits.sigmas * (F.col("accuracy") / CHI_95)))
    at = fixes.select(session, *FIX, lat.alias("cell_lat"), lon.alias("cell_lon"), metres[0].alias("north"), metres[1].alias("east"), radius.alias("radius"))
    # what is out of reach along an axis goes in the join, by short comparisons: Java does not compile long ones; the exact test follows
    reach = lambda a, m: F.col(a).between(F.least(f"{a}1", f"{a}2") - 1.01 * F.col("radius") / F.col(m), F.greatest(f"{a}1", f"{a}2") + 1.01 * F.col("radius") / F.col(m))
    met = at.join(grid, (F.col("cell_lat") == F.col("grid_lat")) & (F.col("cell_lon") == F.col("grid_lon")) & reach("lat", "north") & reach("lon", "east"), "left")
    x1, y1, x2, y2 = ((F.col(f"lon{k}") - F.col("lon")) * F.col("east") if a == "x" else (F.col(f"lat{k}") - F.col("lat")) * F.col("north") for k in (1, 2) for a in "xy")
    met = met.select("*", x1.alias("x1"), y1.alias("y1"), (x2 - x1).alias("dx"), (y2 - y1).alias("dy"))
    n = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    place = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(F.col("x1") * F.col("dx") + F.col("y1") * F.col("dy")) / n))).otherwise(F.lit(0.0))
    met = met.withColumn("place", place)
    ex, ey = F.col("x1") + F.col("place") * F.col("dx"), F.col("y1") + F.col("place") * F.col("dy")
    met = met.withColumn("distance_m", F.sqrt(ex * ex + ey * ey)).withColumn("near", F.coalesce(F.col("distance_m") <= F.col("radius"), F.lit(False)))
    part = lambda a: F.col(f"{a}1") + F.col("place") * (F.col(f"{a}2") - F.col(f"{a}1"))
    # roads that meet in a fix's nearest corner are equally far: the lower segment comes first, whatever the last digits
    met = met.select(session, *FIX, "near", F.round("distance_m", 6).alias("order"), *WHOLE, part("lat").alias("near_lat"), part("lon").alias("near_lon"), "distance_m", F.atan2("dx", "dy").alias("heading_rad"))
    w = Window.partitionBy("fix").orderBy(F.when(F.col("near"), F.col("order")).asc_nulls_last(), "segment")
    found = F.when(F.col("near"), F.struct("order", "segment", "distance_m", "u", "v", "way", "near_lat", "near_lon", "heading_rad"))
    ranked = met.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") == 1) | (F.col("near") & (F.col("rank") <= limits.candidates)))
    first = [F.first(c).alias(c) for c in (session, *[c for c in FIX if c != "fix"])]
    one = ranked.groupBy("fix").agg(*first, F.sort_array(F.collect_list(found)).alias("c"))
    return one.select(session, *FIX, inside.alias("covered"), *[F.col(f"c.{x}").alias(x) for x in (*WHOLE, *PARTS)])


def _metres(lat: str) -> tuple[Column, Column]:
    """Metres of a degree north and east, by the ellipsoid's radii at a latitude."""
    w = 1 - WGS84_E2 * F.pow(F.sin(F.radians(lat)), 2)
    return F.radians(F.lit(1.0)) * WGS84_A * (1 - WGS84_E2) / F.pow(w, 1.5), F.radians(F.lit(1.0)) * WGS84_A / F.sqrt(w) * F.cos(F.radians(lat))


def between(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres between near points, by the ellipsoid's radii at the first."""
    a = np.radians(lat1)
    w = 1 - WGS84_E2 * np.sin(a) ** 2
    north, east = WGS84_A * (1 - WGS84_E2) / w**1.5, WGS84_A / np.sqrt(w) * np.cos(a)
    return np.hypot(np.radians(lon2 - lon1) * east, np.radians(lat2 - lat1) * north)


def residual(heading: np.ndarray, road: np.ndarray) -> np.ndarray:
    """Angle between a heading and a road, which has no direction."""
    d = np.abs(np.mod(heading - road + np.pi, 2 * np.pi) - np.pi)
    return np.minimum(d, np.pi - d)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class _Fixes:
    """One fix of each session, as arrays; candidates beyond a fix's own have an infinite distance."""

    def __init__(self, rows: pa.Table, limits: Limits) -> None:
        self.n = rows.num_rows
        self.t, self.lat, self.lon, self.heading, self.accuracy, self.speed = (rows[c].to_numpy().astype(float) for c in ("t", "lat", "lon", "heading", "accuracy", "speed"))
        self.fix = rows["fix"].to_numpy()
        c = limits.candidates
        self.size = np.nan_to_num(pc.list_value_length(rows["segment"].combine_chunks()).to_numpy(zero_copy_only=False)).astype(np.int64)
        self.there = np.arange(c) < self.size[:, None]
        for x in PARTS:
            setattr(self, x, padded(rows[x], c))
        for x in WHOLE:
            setattr(self, x, self._whole(rows[x], c))
        sigma = self.accuracy / CHI_95
        self.spread = np.maximum(limits.floor, sigma)
        with np.errstate(invalid="ignore"):
            bad = ~np.isfinite(self.t) | (self.t < 0) | ~np.isfinite(self.accuracy) | (self.accuracy <= 0) | (np.abs(self.lat) > 90) | (np.abs(self.lon) > 180) | (self.speed < 0) | ~np.isfinite(self.lat) | ~np.isfinite(self.lon)
        self.status = np.select([bad, ~rows["covered"].to_numpy(zero_copy_only=False).astype(bool), self.accuracy > limits.most_accuracy], ["invalid", "outside", "low_confidence"], "").astype(object)
        use = np.isfinite(self.heading) & (np.isnan(self.speed) | (self.speed >= limits.heading_speed))
        with np.errstate(invalid="ignore"):
            e = -0.5 * (self.distance_m / self.spread[:, None]) ** 2
            e = e - np.where(use[:, None], 0.5 * (residual(self.heading[:, None], self.heading_rad) / limits.heading_sigma) ** 2, 0)
        self.emission = np.where(self.there, e, -np.inf)

    @staticmethod
    def _whole(column: pa.ChunkedArray, width: int) -> np.ndarray:
        lists = column.combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        out = np.zeros((len(lists), width), np.int64)
        out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def cross(self, i: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signed metres along the road's normal that bring a fix onto it, and that normal east and north."""
        a = np.radians(self.lat[i])
        w = 1 - WGS84_E2 * np.sin(a) ** 2
        north, east = WGS84_A * (1 - WGS84_E2) / w**1.5, WGS84_A / np.sqrt(w) * np.cos(a)
        h = self.heading_rad[i, best]
        ne, nn = np.cos(h), -np.sin(h)
        return np.radians(self.near_lon[i, best] - self.lon[i]) * east * ne + np.radians(self.near_lat[i, best] - self.lat[i]) * north * nn, ne, nn


def _topology(a: _Fixes | dict, b: _Fixes, i: np.ndarray, get) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Same segment, shared node, same way: of each earlier candidate and each present one."""
    seg, u, v, way = (get(x) for x in WHOLE)
    same = seg[:, :, None] == b.segment[i][:, None, :]
    node = np.zeros_like(same)
    for x in (u, v):
        for y in (b.u[i], b.v[i]):
            node |= x[:, :, None] == y[:, None, :]
    return same, node, way[:, :, None] == b.way[i][:, None, :]


_OUT = ("status", "segment", "confidence", "distance_m", "n", "cross_m", "normal_east", "normal_north")
SCHEMA = "kind string, t double, fix long, status string, segment long, confidence double, distance_m double, n int, cross_m double, normal_east double, normal_north double"


class _TrellisStack:
    """Forward shares, best paths and a ring of back-pointers of many sessions."""

    def __init__(self, n: int, limits: Trellis) -> None:
        self.limits, c, r = limits, limits.candidates, limits.lag + 1
        self.count = np.zeros(n, np.int64)
        self.alpha, self.delta = np.full((n, c), -np.inf), np.full((n, c), -np.inf)
        self.lat, self.lon, self.t = np.zeros(n), np.zeros(n), np.zeros(n)
        for x in ("near_lat", "near_lon"):
            setattr(self, x, np.zeros((n, c)))
        for x in WHOLE:
            setattr(self, x, np.zeros((n, c), np.int64))
        self.back, self.ring = np.zeros((n, r, c), np.int64), np.zeros((n, r, c), np.int64)
        self.ring_t, self.ring_fix = np.zeros((n, r)), np.zeros((n, r), np.int64)
        self.known = np.zeros(n, bool)
        self.last = {"status": np.full(n, "", object), "segment": np.zeros(n, np.int64), "n": np.zeros(n, np.int64)} | {x: np.full(n, np.nan) for x in _OUT if x not in ("status", "segment", "n")}

    def keep(self, on: np.ndarray) -> None:
        for name in ("count", "alpha", "delta", "lat", "lon", "t", "near_lat", "near_lon", *WHOLE, "back", "ring", "ring_t", "ring_fix", "known"):
            setattr(self, name, getattr(self, name)[on])
        self.last = {k: x[on] for k, x in self.last.items()}

    def _decided(self, i: np.ndarray, steps: int, late: list) -> None:
        """The segment ``steps`` columns before the last, on the best path to it."""
        r = self.limits.lag + 1
        best = self.delta[i].argmax(axis=1)
        for k in range(steps):
            best = self.back[i, (self.count[i] - 1 - k) % r, best]
        at = (self.count[i] - 1 - steps) % r
        late.append((i, self.ring_t[i, at], self.ring_fix[i, at], self.ring[i, at, best]))

    def _flushed(self, i: np.ndarray, late: list) -> None:
        """What is undecided at an end or a gap: all but what was decided on the way."""
        for steps in range(self.limits.lag - 1, -1, -1):
            some = i[self.count[i] > steps]
            if len(some):
                self._decided(some, steps, late)
        self.count[i] = 0

    def step(self, rows: pa.Table) -> tuple[np.ndarray, dict]:
        m, f = self.limits, _Fixes(rows, self.limits)
        late: list = []
        out = {"status": f.status, "segment": np.zeros(f.n, np.int64), "n": np.zeros(f.n, np.int64)} | {x: np.full(f.n, np.nan) for x in _OUT if x not in ("status", "segment", "n")}
        with np.errstate(invalid="ignore", divide="ignore"):
            live = f.status == ""
            prior = live & (self.count > 0)
            gap = prior & (f.t - self.t > m.longest_gap)
            near = prior & ~gap & (between(self.lat, self.lon, f.lat, f.lon) < m.least_step) & self.known
            for k in out:
                out[k][near] = self.last[k][near]
            self._flushed(np.flatnonzero(gap), late)
            none = live & ~near & (f.size == 0)
            out["status"][none] = "no_candidate"
            i = np.flatnonzero(live & ~near & (f.size > 0))
            e = f.emission[i]
            alpha, delta, back = e.copy(), e.copy(), np.zeros(e.shape, np.int64)
            k = np.flatnonzero(self.count[i] > 0)
            if len(k):
                j = i[k]
                seen = between(self.lat[j], self.lon[j], f.lat[j], f.lon[j])
                way = between(self.near_lat[j][:, :, None], self.near_lon[j][:, :, None], f.near_lat[j][:, None, :], f.near_lon[j][:, None, :])
                same, node, road = _topology({}, f, j, lambda x: getattr(self, x)[j])
                move = -np.abs(way - seen[:, None, None]) / m.beta + np.log(np.select([same, node, road], [m.same, m.node, m.way], m.other))
                move = np.where(np.isfinite(self.alpha[j])[:, :, None] & f.there[j][:, None, :], move, -np.inf)
                total = self.delta[j][:, :, None] + move
                back[k] = total.argmax(axis=1)
                delta[k] = total.max(axis=1) + e[k]
                alpha[k] = _log_sum(self.alpha[j][:, :, None] + move, 1) + e[k]
            alpha, delta = alpha - _log_sum(alpha, 1)[:, None], delta - delta.max(axis=1, keepdims=True)
        at = self.count[i] % (m.lag + 1)
        self.alpha[i], self.delta[i], self.back[i, at], self.ring[i, at], self.ring_t[i, at], self.ring_fix[i, at] = alpha, delta, back, f.segment[i], f.t[i], f.fix[i]
        self.lat[i], self.lon[i], self.t[i] = f.lat[i], f.lon[i], f.t[i]
        for x in ("near_lat", "near_lon", *WHOLE):
            getattr(self, x)[i] = getattr(f, x)[i]
        self.count[i] += 1
        some = i[self.count[i] > m.lag]
        if len(some):
            self._decided(some, m.lag, late)
        best = alpha.argmax(axis=1)
        share = np.exp(alpha[np.arange(len(i)), best])
        sure = share >= m.least_confidence
        cross, east, north = f.cross(i, best)
        hide = lambda x: np.where(sure, x, np.nan)
        got = {"status": np.where(sure, "matched", "low_confidence"), "segment": f.segment[i, best], "confidence": share, "distance_m": f.distance_m[i, best], "n": f.size[i], "cross_m": hide(cross), "normal_east": hide(east), "normal_north": hide(north)}
        for k, x in got.items():
            out[k][i] = x
            self.last[k][i] = x
        self.known[i] = True
        self._flushed(np.flatnonzero(rows["last"].to_numpy(zero_copy_only=False) & (self.count > 0)), late)
        who = np.concatenate([np.arange(f.n), *[x[0] for x in late]])
        lagged = sum(len(x[0]) for x in late)
        shown = np.concatenate([out["status"] == "matched", np.ones(lagged, bool)])
        blank = lambda x: np.concatenate([x, np.full(lagged, np.nan)])
        join = lambda x, k: np.concatenate([x, *[y[k] for y in late]])
        return who, {
            "kind": pa.array(["now"] * f.n + ["lag"] * lagged), "t": join(f.t, 1), "fix": join(f.fix, 2), "status": pa.array([*out["status"], *["smoothed"] * lagged], pa.string()),
            "segment": pa.array(join(out["segment"], 3), mask=~shown), "confidence": blank(out["confidence"]), "distance_m": blank(out["distance_m"]), "n": pa.array(np.concatenate([out["n"], np.zeros(lagged, np.int64)]).astype(np.int32)),
            "cross_m": blank(out["cross_m"]), "normal_east": blank(out["normal_east"]), "normal_north": blank(out["normal_north"]),
        }


class _GreedyStack:
    """The last segment of many sessions."""

    def __init__(self, n: int, limits: Greedy) -> None:
        self.limits = limits
        self.on = np.zeros(n, bool)
        self.lat, self.lon, self.t = np.zeros(n), np.zeros(n), np.zeros(n)
        for x in WHOLE:
            setattr(self, x, np.zeros((n, 1), np.int64))

    def keep(self, on: np.ndarray) -> None:
        for name in ("on", "lat", "lon", "t", *WHOLE):
            setattr(self, name, getattr(self, name)[on])

    def step(self, rows: pa.Table) -> tuple[np.ndarray, dict]:
        m, f = self.limits, _Fixes(rows, self.limits)
        status = f.status
        live = status == ""
        status[live & (f.size == 0)] = "no_candidate"
        i = np.flatnonzero(live & (f.size > 0))
        confidence, distance, cross, east, north = (np.full(f.n, np.nan) for _ in range(5))
        segment, count = np.zeros(f.n, np.int64), np.zeros(f.n, np.int64)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore", under="ignore"):
            score = np.exp(f.emission[i])
            k = np.flatnonzero(self.on[i])
            j = i[k]
            if len(j):
                same, node, road = (x[:, 0] for x in _topology({}, f, j, lambda x: getattr(self, x)[j]))
                factor = np.select([same | node, road], [m.node, m.way], 1.0)
                dt = f.t[j] - self.t[j]
                allowed = m.slack + np.where(np.isnan(f.speed[j]), m.usual_speed, f.speed[j]) * dt
                over = between(self.lat[j][:, None], self.lon[j][:, None], f.near_lat[j], f.near_lon[j]) - allowed[:, None]
                late = ((dt >= 0) & (dt <= m.horizon))[:, None] & (over > 0)
                score[k] *= np.where(f.there[j], factor * np.where(late, np.exp(-0.5 * (over / f.spread[j][:, None]) ** 2), 1.0), 0)
            total, best = score.sum(axis=1), score.argmax(axis=1)
            top = score[np.arange(len(i)), best]
            share = np.where(total > 0, top / total, 0)
        sure = (top > 0) & (share >= m.least_confidence)
        status[i] = np.where(sure, "matched", "low_confidence")
        count[i] = f.size[i]
        won = top > 0
        confidence[i], distance[i[won]] = share, f.distance_m[i[won], best[won]]
        i, best = i[sure], best[sure]
        segment[i] = f.segment[i, best]
        cross[i], east[i], north[i] = f.cross(i, best)
        self.on[i], self.t[i], self.lat[i], self.lon[i] = True, f.t[i], f.near_lat[i, best], f.near_lon[i, best]
        for x in WHOLE:
            getattr(self, x)[i, 0] = getattr(f, x)[i, best]
        out = {"status": pa.array(status, pa.string()), "segment": pa.array(segment, mask=status != "matched"), "confidence": confidence, "distance_m": distance, "n": pa.array(count.astype(np.int32)), "cross_m": cross, "normal_east": east, "normal_north": north}
        return np.arange(f.n), {"kind": pa.array(["now"] * f.n), "t": f.t, "fix": f.fix, **out}


def _stepped(fixes: DataFrame, session: str, make) -> DataFrame:  # noqa: ANN001
    order = last_nulls("t", "fix")
    last = F.lead(F.lit(1)).over(Window.partitionBy(session).orderBy(*order)).isNull()
    columns = [*FIX, "covered", *WHOLE, *PARTS, "last"]
    return together(fixes.withColumn("last", last), session, order, columns, make, SCHEMA)


def trellis_match(fixes: DataFrame, segments: DataFrame, session: str, limits: Trellis | None = None) -> DataFrame:
    """For each fix a row ``now`` (what is likeliest with the fixes so far) and, if it stands in the trellis, a row ``lag``: its segment on the
    likeliest path ``limits.lag`` fixes later, or at the session's end or gap.

    Fixes that moved less than a step repeat the row before. Refusals (``invalid``, ``outside``, ``low_confidence``, ``no_candidate``) leave the trellis as it is.
    """
    m = limits or Trellis()
    return _stepped(with_candidates(fixes, segments, session, m), session, lambda n: _TrellisStack(n, m))


def greedy_match(fixes: DataFrame, segments: DataFrame, session: str, limits: Greedy | None = None) -> DataFrame:
    """For each fix the segment with the largest share of the evidence, weighed by what goes on from the last match and can be reached from it; ambiguous ones are refused."""
    m = limits or Greedy()
    return _stepped(with_candidates(fixes, segments, session, m), session, lambda n: _GreedyStack(n, m))
