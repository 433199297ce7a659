"""Both matchers against plain Python: candidates, every path of short drives, one fix at a time."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import matching

A, E2 = 6378137.0, 0.0066943799901413165
NODES = {k: (12.9 + 0.0006 * (k // 4), 77.5 + 0.0006 * (k % 4)) for k in range(12)}


def roads():
    """A grid of three by four corners; ways are its rows and columns."""
    out = []
    for k in NODES:
        for other, way in ((k + 1, 100 + k // 4), (k + 4, 200 + k % 4)):
            if other in NODES and (other == k + 4 or k % 4 < 3):
                out.append((len(out), k, other, way, *NODES[k], *NODES[other]))
    return out


def metres(lat):
    w = 1 - E2 * math.sin(math.radians(lat)) ** 2
    return math.radians(1) * A * (1 - E2) / w**1.5, math.radians(1) * A / math.sqrt(w) * math.cos(math.radians(lat))


def distance(a, b):
    north, east = metres(a[0])
    return math.hypot((b[1] - a[1]) * east, (b[0] - a[0]) * north)


def nearest(fix, lim):
    """Candidates of a fix: (distance, road, point, heading), nearest first."""
    _, _, lat, lon, _, accuracy, _ = fix
    north, east = metres(lat)
    radius = min(lim.most_radius, max(lim.least_radius, lim.sigmas * accuracy / math.sqrt(5.991)))
    out = []
    for r in roads():
        x1, y1, x2, y2 = (r[5] - lon) * east, (r[4] - lat) * north, (r[7] - lon) * east, (r[6] - lat) * north
        dx, dy = x2 - x1, y2 - y1
        p = max(0.0, min(1.0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy)))
        d = math.hypot(x1 + p * dx, y1 + p * dy)
        if d <= radius:
            out.append((d, r[0], r, (r[4] + p * (r[6] - r[4]), r[5] + p * (r[7] - r[5])), math.atan2(dx, dy)))
    return sorted(out, key=lambda c: (round(c[0], 6), c[1]))[: lim.candidates]


def emission(fix, c, lim):
    sigma = max(lim.floor, fix[5] / math.sqrt(5.991))
    e = -0.5 * (c[0] / sigma) ** 2
    if fix[4] is not None and (fix[6] is None or fix[6] >= lim.heading_speed):
        d = abs(math.atan2(math.sin(fix[4] - c[4]), math.cos(fix[4] - c[4])))
        e -= 0.5 * (min(d, math.pi - d) / lim.heading_sigma) ** 2
    return e


def refusal(fix, lim):
    t, _, lat, lon, _, accuracy, speed = fix
    if t is None or t < 0 or accuracy is None or accuracy <= 0 or lat is None or abs(lat) > 90 or (speed is not None and speed < 0):
        return "invalid"
    lats, lons = [p[0] for p in NODES.values()], [p[1] for p in NODES.values()]
    if not (min(lats) - lim.margin <= lat <= max(lats) + lim.margin and min(lons) - lim.margin <= lon <= max(lons) + lim.margin):
        return "outside"
    return "low_confidence" if accuracy > lim.most_accuracy else None


def touch(a, b):
    return bool({a[1], a[2]} & {b[1], b[2]})


def trellis(fixes, lim):
    """Statuses and shares by sums over all paths; what each column is decided to be by the best of all paths."""
    now, decided, columns, last = [], {}, [], None

    def move(a, b, fa, fb):
        seen = distance(fa[2:4], fb[2:4])
        factor = lim.same if a[1] == b[1] else lim.node if touch(a[2], b[2]) else lim.way if a[2][3] == b[2][3] else lim.other
        return -abs(distance(a[3], b[3]) - seen) / lim.beta + math.log(factor)

    def paths():
        for p in itertools.product(*[range(len(c)) for _, c in columns]):
            w = sum(emission(f, c[i], lim) for (f, c), i in zip(columns, p, strict=True))
            w += sum(move(ca[i], cb[j], fa, fb) for (fa, ca), (fb, cb), i, j in zip(columns, columns[1:], p, p[1:], strict=False))
            yield w, p

    def flush():
        if columns:
            best = max(paths(), key=lambda x: x[0])[1]
            for (f, c), i in zip(columns, best, strict=True):
                decided.setdefault(f[1], c[i][1])
        columns.clear()

    for f in fixes:
        status = refusal(f, lim)
        if status:
            now.append((f[1], status, None, None))
            continue
        if columns:
            before = columns[-1][0]
            if f[0] - before[0] > lim.longest_gap:
                flush()
            elif distance(before[2:4], f[2:4]) < lim.least_step and last:
                now.append((f[1], *last))
                continue
        c = nearest(f, lim)
        if not c:
            now.append((f[1], "no_candidate", None, None))
            continue
        columns.append((f, c))
        found = list(paths())
        top = max(w for w, _ in found)
        share = np.zeros(len(c))
        for w, p in found:
            share[p[-1]] += math.exp(w - top)
        share /= share.sum()
        if len(columns) > lim.lag:
            best = max(found, key=lambda x: x[0])[1]
            k = len(columns) - 1 - lim.lag
            decided.setdefault(columns[k][0][1], columns[k][1][best[k]][1])
        i = int(share.argmax())
        sure = share[i] >= lim.least_confidence
        last = ("matched" if sure else "low_confidence", c[i][1] if sure else None, float(share[i]))
        now.append((f[1], *last))
    flush()
    return now, decided


def greedy(fixes, lim):
    out, on = [], None
    for f in fixes:
        status = refusal(f, lim)
        c = [] if status else nearest(f, lim)
        if not c:
            out.append((f[1], status or "no_candidate", None, None))
            continue
        sigma, scores = max(lim.floor, f[5] / math.sqrt(5.991)), []
        for x in c:
            s = math.exp(emission(f, x, lim))
            if on:
                road, point, t = on
                s *= lim.node if road[0] == x[1] or touch(road, x[2]) else lim.way if road[3] == x[2][3] else 1.0
                dt = f[0] - t
                over = distance(point, x[3]) - lim.slack - (lim.usual_speed if f[6] is None else f[6]) * dt
                if 0 <= dt <= lim.horizon and over > 0:
                    s *= math.exp(-0.5 * (over / sigma) ** 2)
            scores.append(s)
        i = int(np.argmax(scores))
        share = scores[i] / sum(scores) if sum(scores) > 0 else 0.0
        sure = scores[i] > 0 and share >= lim.least_confidence
        if sure:
            on = (c[i][2], c[i][3], f[0])
        out.append((f[1], "matched" if sure else "low_confidence", c[i][1] if sure else None, share))
    return out


def drive(seed, n):
    draw = np.random.default_rng(seed)
    out, t = [], 0.0
    lat, lon = 12.9 + draw.random() * 0.0012, 77.5 + draw.random() * 0.0018
    for k in range(n):
        t += float(draw.choice([1.0, 2.0, 5.0, 40.0], p=[0.5, 0.3, 0.15, 0.05]))
        lat, lon = lat + float(draw.choice([0.0, 0.00001, 0.0002, -0.0002])), lon + float(draw.choice([0.0, 0.0002, -0.0001]))
        odd = draw.random()
        out.append((t, 1000 * seed + k, lat + 0.5 * (odd < 0.05), lon, None if odd > 0.8 else float(draw.random() * 6), 0.0 if (seed, k) == (3, 4) else float(draw.choice([70.0, 20.0, 30.0], p=[0.08, 0.52, 0.4])), None if odd < 0.3 else float(draw.random() * 12)))
    return out


@pytest.fixture(scope="module")
def network(spark):
    return spark.createDataFrame(roads(), "segment long, u long, v long, way long, lat1 double, lon1 double, lat2 double, lon2 double")


@pytest.fixture(scope="module")
def drives(spark):
    rows = {s: drive(s, n) for s, n in ((1, 7), (2, 9), (3, 8), (4, 1), (5, 9), (6, 6))}
    df = spark.createDataFrame([(s, *f) for s, fs in rows.items() for f in fs], "session int, t double, fix long, lat double, lon double, heading double, accuracy double, speed double")
    return rows, df.repartition(4)


def test_candidates(network, drives):
    rows, df = drives
    lim = matching.Trellis(candidates=3)
    got = {r.fix: r for r in matching.with_candidates(df, network, "session", lim).collect()}
    assert len(got) == sum(map(len, rows.values()))
    for f in itertools.chain(*rows.values()):
        want, r = nearest(f, lim), got[f[1]]
        assert r.segment == [c[1] for c in want] and np.allclose(r.distance_m, [c[0] for c in want], atol=1e-6) and np.allclose(r.heading_rad, [c[4] for c in want])
        assert r.covered == (refusal((1.0, 0, *f[2:5], 20.0, None), lim) != "outside")


@pytest.mark.parametrize("lag", [1, 3, 50])
def test_trellis_equals_all_paths(network, drives, lag):
    rows, df = drives
    lim = matching.Trellis(candidates=3, lag=lag)
    got = matching.trellis_match(df, network, "session", lim).collect()
    now = {r.fix: r for r in got if r.kind == "now"}
    seen = set()
    for fixes in rows.values():
        want, decided = trellis(fixes, lim)
        for fix, status, segment, share in want:
            assert (now[fix].status, now[fix].segment) == (status, segment)
            assert share is None or math.isclose(now[fix].confidence, share, rel_tol=1e-9)
            seen.add(status)
        assert {r.fix: r.segment for r in got if r.kind == "lag" and r.fix in {f[1] for f in fixes}} == decided
    assert seen == {"matched", "low_confidence", "outside", "invalid"} | ({"no_candidate"} & seen)
    assert len([r for r in got if r.kind == "lag"]) == len({r.fix for r in got if r.kind == "lag"})


def test_greedy_equals_one_fix_at_a_time(network, drives):
    rows, df = drives
    lim = matching.Greedy(candidates=4)
    got = {r.fix: r for r in matching.greedy_match(df, network, "session", lim).collect()}
    for fixes in rows.values():
        for fix, status, segment, share in greedy(fixes, lim):
            assert (got[fix].status, got[fix].segment) == (status, segment)
            assert share is None or math.isclose(got[fix].confidence, share, rel_tol=1e-9, abs_tol=1e-12)


def test_one_join_one_sort_and_an_empty_network(spark, network, drives):
    _, df = drives
    plan = matching.trellis_match(df, network, "session")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    out = matching.greedy_match(df, network.limit(0), "session").collect()
    assert {r.status for r in out} == {"outside", "invalid"}
    assert matching.trellis_match(df.limit(0), network, "session").collect() == []


@pytest.fixture(scope="module")
def city(spark):
    """A street grid of 60,000 segments out of 60,000 numbers, which Spark takes for half a megabyte."""
    p = spark.range(60_000).select("id", (F.col("id") % 2).alias("up"), (F.floor(F.col("id") / 2) % 150).alias("i"), F.floor(F.col("id") / 300).alias("j"))
    i2, j2 = F.col("i") + 1 - F.col("up"), F.col("j") + F.col("up")
    corner = lambda i, j: (F.lit(12.89) + j * 0.0006, F.lit(77.49) + i * 0.0006)
    (lat1, lon1), (lat2, lon2) = corner(F.col("i"), F.col("j")), corner(i2, j2)
    way = F.when(F.col("up") == 1, F.col("i") * 2 + 1).otherwise(F.col("j") * 2)
    return p.select(F.col("id").alias("segment"), (F.col("j") * 1000 + F.col("i")).alias("u"), (j2 * 1000 + i2).alias("v"), way.alias("way"), lat1.alias("lat1"), lon1.alias("lon1"), lat2.alias("lat2"), lon2.alias("lon2"))


def broadcast_or_not(match, df, city, monkeypatch):
    """Rows of a match whose network's cells are over the limit for a broadcast, and under it."""
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    large = match(df, city, "session")
    assert "Broadcast" not in plan(large) and "CartesianProduct" not in plan(large)
    rows = sorted(map(str, large.collect()))
    monkeypatch.setattr(matching, "BROADCAST", 1 << 30)
    small = match(df, city, "session")
    assert "BroadcastHashJoin" in plan(small) and rows == sorted(map(str, small.collect()))
    return rows


def test_greedy_does_not_broadcast_a_large_network(drives, city, monkeypatch):
    rows, df = drives
    assert len(broadcast_or_not(matching.greedy_match, df, city, monkeypatch)) == sum(map(len, rows.values()))


def test_trellis_does_not_broadcast_a_large_network(drives, city, monkeypatch):
    _, df = drives
    assert broadcast_or_not(matching.trellis_match, df, city, monkeypatch)


def test_reach_loses_no_candidate(drives, city):
    """Roads beside which a fix is just within its radius, slanting ones too, against all pairs."""
    _, df = drives
    slant = city.filter("segment < 30000").withColumn("lat2", F.col("lat2") + 0.0003).withColumn("lon2", F.col("lon2") - 0.0002)
    lim = matching.Limits(candidates=100)
    got = {(r.fix, s) for r in matching.with_candidates(df, slant, "session", lim).collect() for s in r.segment}
    ids, lat1, lon1, lat2, lon2 = np.array([tuple(r) for r in slant.select("segment", "lat1", "lon1", "lat2", "lon2").collect()]).T
    want = set()
    for r in df.collect():
        north, east = metres(r.lat)
        x1, y1, x2, y2 = (lon1 - r.lon) * east, (lat1 - r.lat) * north, (lon2 - r.lon) * east, (lat2 - r.lat) * north
        p = np.clip(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
        near = np.hypot(x1 + p * (x2 - x1), y1 + p * (y2 - y1)) <= min(lim.most_radius, max(lim.least_radius, lim.sigmas * r.accuracy / math.sqrt(5.991)))
        want |= {(r.fix, int(i)) for i in ids[near]}
    assert got == want and len(want) > 50
