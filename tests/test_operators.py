"""Single operators with answers worked out by hand, and windows that must ignore the future."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import geodesy, rotations, scalars
from driftline.operators import profiles, sequential, spatial, temporal, validation, windows
from driftline.plans import audits
from driftline.sources import files, records
from driftline.sources.tables import events
from driftline.streaming import live


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_interpolation_averages_repeats_and_never_extrapolates(spark):
    right = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0), (1, 10, 30.0), (1, 20, 0.0), (1, 100, 8.0)], "k int, t long, x double")
    left = spark.createDataFrame([(1, t) for t in (-1, 0, 5, 10, 15, 20, 60, 100, 101)] + [(2, 5)], "k int, t long")
    got = {(r.k, r.t): r.i_x for r in temporal.interp_join(left, right, ["k"], "t", ["x"], max_gap=50).collect()}
    assert got == {(1, -1): None, (1, 0): 0.0, (1, 5): 10.0, (1, 10): 20.0, (1, 15): 10.0, (1, 20): 0.0, (1, 60): None, (1, 100): 8.0, (1, 101): None, (2, 5): None}


def test_asof_and_nearest(spark):
    right = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 20, "c")], "k int, t long, x string")
    left = spark.createDataFrame([(1, 9), (1, 10), (1, 15), (1, 19), (1, 25), (2, 1)], "k int, t long")
    assert {(r.k, r.t): r.r_x for r in temporal.asof_join(left, right, ["k"], "t").collect()} == {(1, 9): None, (1, 10): "a", (1, 15): "a", (1, 19): "a", (1, 25): "c", (2, 1): None}
    assert {(r.k, r.t): r.r_x for r in temporal.asof_join(left, right, ["k"], "t", forward=True).collect()} == {(1, 9): "a", (1, 10): "a", (1, 15): "b", (1, 19): "b", (1, 25): None, (2, 1): None}
    assert {(r.k, r.t): r.r_x for r in temporal.nearest_join(left, right, ["k"], "t", within=4).collect()} == {(1, 9): "a", (1, 10): "a", (1, 15): None, (1, 19): "b", (1, 25): None, (2, 1): None}


def test_intervals_are_half_open_and_merge(spark):
    iv = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (1, 5, 5)], "k int, s long, e long")
    pts = spark.createDataFrame([(1, t) for t in (-1, 0, 9, 10, 19, 20, 30, 39, 40)], "k int, t long")
    for width in (3, 10, 1000):
        assert sorted(t for (t,) in one(temporal.masked(pts, iv, ["k"], "t", "s", "e", width=width), "t")) == [-1, 20, 40]
        assert temporal.range_join(pts, iv, ["k"], "t", "s", "e", width=width).count() == 6
    assert sorted(one(temporal.merged(iv.filter("s < e"), ["k"], "s", "e"), "s", "e")) == [(0, 20), (30, 40)]


def test_clock_with_gaps_repeats_and_resets(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 100, 200, 200, 300, 900, 850])], "k int, i int, t long")
    r = profiles.clock_stats(df, ["k"], "i", "t", floor=0.25, factor=2.5, scale=1000.0).first()
    assert (r.n_intervals, r.n_repeated, r.n_back, r.n_gaps, r.missing, r.median_dt) == (6, 1, 1, 1, 5, 0.1)


def test_segments_merge_short_runs(spark):
    labels = ["stop"] * 5 + ["fast"] + ["stop"] * 5 + ["fast"] * 6
    df = spark.createDataFrame([(1, i, x, 1.0) for i, x in enumerate(labels)], "k int, t long, label string, value double")
    got = one(windows.run_segments(df, ["k"], "t", "label", shortest=3, other="moving").orderBy("start"), "label", "start", "end", "n")
    assert got == [("stop", 0, 5, 5), ("moving", 5, 6, 1), ("stop", 6, 11, 5), ("fast", 11, 16, 6)]


@pytest.mark.parametrize("name", ["rolling_bandpower", "cumulative_trapezoid", "sliding_window_stats", "recent_features", "reorder_lateness", "travelled_distance"])
def test_windows_ignore_the_future(spark, sf, name, tmp_path):
    from driftline import plans

    plans.load()
    full = spark.read.parquet(f"{sf}/events.parquet")
    cut = full.filter("event_id < 600")
    (a, b) = (tmp_path / "a", tmp_path / "b")
    # keep what is before each session's last kept time, so that only later rows go
    last = cut.groupBy("user_id").agg(F.max("ts").alias("last"))
    early = full.join(last, "user_id").filter(F.col("ts") <= F.col("last")).drop("last")
    full.write.parquet(f"{a}/events.parquet")
    early.write.parquet(f"{b}/events.parquet")
    ids = early.select("event_id")
    x = plans.QUERIES[name](spark, str(a)).join(ids, "event_id", "left_semi")
    y = plans.QUERIES[name](spark, str(b))
    assert sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect()))


def test_greedy_plan(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 5, 14, 15, 16, 40)], "k int, t long")
    assert sorted(one(sequential.planned(df, ["k"], "t", F.lit(True), 10, 5), "start", "end")) == [(0, 10), (15, 25), (40, 50)]


def test_admission_and_codes(spark):
    df = spark.createDataFrame([(1.0, "A_B"), (float("nan"), "a"), (None, None)], "x double, c string")
    codes = validation.errors({"NUM": validation.rule("num", F.col("x")), "OPT": validation.rule("num?", F.col("x")), "CODE": validation.rule("code", F.col("c"))})
    assert [r[0] for r in df.select(codes).collect()] == [[], ["NUM", "OPT", "CODE"], ["NUM", "CODE"]]
    d, why = validation.admission({"A": F.col("x") > 0, "B": F.col("c") == "A_B"}, 1)
    assert one(df, d, why) == [("approved", ""), ("conditional", "B"), ("quarantined", "A; B")]


def test_geodesy(spark):
    row = spark.range(1).select(
        geodesy.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), geodesy.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"),
        geodesy.normal_gravity(F.lit(90.0), F.lit(0.0)).alias("g"), geodesy.normal_gravity(F.lit(45.0), F.lit(1000.0)).alias("g1"), scalars.wrap180(F.lit(540.0)).alias("w"), geodesy.valid_coordinates(F.lit(0.0), F.lit(0.0)).alias("v"),
    ).first()
    assert math.isclose(row.d, math.radians(1) * 6_371_000) and math.isclose(row.b, 90) and abs(row.g - 9.8321849) < 1e-6 and abs(row.g1 - 9.803113) < 1e-4 and row.w == -180 and row.v is False


def test_rotations_agree(spark, sf):
    from driftline import plans

    plans.load()
    r = plans.QUERIES["rotation_identities"](spark, sf).agg(*[F.min(F.col(c).cast("int")).alias(c) for c in ("is_rotation", "same", "length_kept", "arc_ends")]).first()
    assert tuple(r) == (1, 1, 1, 1)
    g = plans.QUERIES["geodesy_round_trips"](spark, sf).agg(F.min(F.col("enu_ok").cast("int")), F.min(F.col("ecef_ok").cast("int"))).first()
    assert tuple(g) == (1, 1)


def test_euler_and_angles(spark):
    m = rotations.euler_matrix(F.lit(math.pi / 2), F.lit(0.0), F.lit(0.0))
    df = spark.range(1).select(m.alias("m"))
    row = df.select(rotations.mat_vec(F.col("m"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("v"), rotations.rotation_angle(F.col("m")).alias("a"), rotations.tilt_heading(F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("h")).first()
    assert np.allclose(row.v, [0, 1, 0]) and math.isclose(row.a, math.pi / 2) and min(row.h, 360 - row.h) < 1e-9


def test_strapdown_keeps_still_and_turns(spark):
    rows = [(1, i * 0.1, 0.0, 0.0, 9.80665, 0.0, 0.0, 0.1) for i in range(101)]
    out = sequential.propagated(spark.createDataFrame(rows, "s long, t double, fx double, fy double, fz double, wx double, wy double, wz double"), "s").orderBy("t").collect()[-1]
    assert abs(out.px) + abs(out.py) + abs(out.pz) < 1e-9 and math.isclose(2 * math.atan2(out.qz, out.qw), 1.0, rel_tol=1e-9)


def test_filter_follows_fixes_and_refuses_outliers(spark):
    rows = [(1, float(i), "fix", 10.0 * i, 0.0, None, None) for i in range(20)] + [(1, 20.0, "fix", 5000.0, 0.0, None, None), (1, 21.0, "speed", None, None, 10.0, math.pi / 2)]
    out = {r.t: r for r in sequential.filtered(spark.createDataFrame(rows, "s long, t double, kind string, east double, north double, speed double, heading double"), "s").collect()}
    assert out[19.0].taken and abs(out[19.0].v_east - 10) < 1.5 and not out[20.0].taken and out[20.0].nis > 9.21 and out[21.0].taken


def test_hmm_stays_on_connected_roads(spark):
    # road 1 (nodes 1-2), road 2 (2-3), road 9 (far away, better at one time)
    rows = []
    for t, best in enumerate([1, 1, 9, 2, 2]):
        for seg, u, v in ((1, 1, 2), (2, 2, 3), (9, 7, 8)):
            rows.append((1, float(t), seg, u, v, 0.0 if seg == best else -3.0, 10.0, 10.0 * t))
    got = sequential.viterbi(spark.createDataFrame(rows, "s long, t double, segment long, u long, v long, log_emission double, travelled_m double, along_m double"), "s").orderBy("t").collect()
    assert [r.segment for r in got][:2] == [1, 1] and 9 not in [r.segment for r in got]


def test_grid_candidates_match_all_pairs(spark):
    draw = np.random.default_rng(0)
    pts = [(i, *map(float, draw.uniform((12.9, 77.5), (12.95, 77.55)))) for i in range(80)]
    seg = [(i, *map(float, draw.uniform((12.9, 77.5, 12.9, 77.5), (12.95, 77.55, 12.95, 77.55)))) for i in range(30)]
    p, s = spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(seg, "segment long, lat1 double, lon1 double, lat2 double, lon2 double")
    grid = spatial.candidates(p, s, point="id", segment="segment", cell=0.01, radius_m=300.0, most=100)
    d, _, _ = spatial.projection(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    every = p.join(s, F.lit(True)).withColumn("d", d).filter("d <= 300")
    assert sorted(one(grid, "id", "segment")) == sorted(one(every, "id", "segment")) and grid.count() > 50


def test_bootstrap_covers_the_mean(spark):
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([(int(i % 40), float(x)) for i, x in enumerate(draw.normal(2, 1, 400))], "c long, d double")
    r = profiles.bootstrap_mean(df, "d", "c", resamples=400).first()
    assert r.low < 2 < r.high and 0.05 < r.high - r.low < 0.6


def test_least_squares_refuses_singular_sessions(spark):
    rows = [(1, 1.0, float(x), 3.0 + 2 * x) for x in range(5)] + [(2, 1.0, 1.0, 5.0)] * 4
    got = {r.s: (r.b_one, r.b_x) for r in sequential.solved(spark.createDataFrame(rows, "s long, one double, x double, y double"), ["s"], ["one", "x"], "y").collect()}
    assert np.allclose(got[1], (3, 2)) and got[2] == (None, None)


def test_records_round_trip_and_reject(spark, sf, tmp_path):
    recs = audits.as_records(events(spark, sf)).filter("gnss.bearing_deg < 360")
    records.write_records(recs, str(tmp_path / "log"))
    back = records.read_records(spark, str(tmp_path / "log"))
    assert back.filter("size(codes) > 0").count() == 0
    assert back.select("session_id", "event_id", "t_ns", "gnss").exceptAll(recs.select("session_id", "event_id", "t_ns", "gnss")).count() == 0
    good = json.loads(recs.transform(records.encoded).first()["value"])
    bad = [json.dumps(good | {"more": 1}), json.dumps(good | {"contract_version": "9"}), "not json", json.dumps(good | {"event": good["event"] | {"t_ns": 5}}), json.dumps(good | {"event": good["event"] | {"received_ns": "1"}}), json.dumps(good | {"event": good["event"] | {"data": good["event"]["data"] | {"latitude_deg": 91.0}}})]
    codes = [r.codes for r in records.decoded(spark.createDataFrame([(x,) for x in bad], "value string")).collect()]
    assert "JSON" in codes[0] and codes[1] == ["VERSION"] and "JSON" in codes[2] and codes[4] == ["TIME"] and codes[5] == ["VALUES"]


def test_csv_headers_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Träge  X,Time\n1,2\n".encode("cp1252"))
    names = {"träge x": "x", "time": "t"}
    assert files.sniffed_encoding(spark, str(tmp_path / "a.csv")) == "windows-1252"
    assert files.read_csv(spark, str(tmp_path / "a.csv"), names).collect()[0].asDict() == {"x": "1", "t": "2"}
    with pytest.raises(ValueError, match="unknown"):
        files.read_csv(spark, str(tmp_path / "a.csv"), {"time": "t"})


def test_inventory_and_integrity(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    sealed = files.inventory(spark, str(tmp_path)).toArrow()
    (tmp_path / "a").write_text("changed")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    got = files.integrity(files.inventory(spark, str(tmp_path)), spark.createDataFrame(sealed.to_pandas()[["path", "sha256"]]))
    assert sorted((r.path[-1], r.finding) for r in got.collect()) == [("a", "changed"), ("b", "missing"), ("d", "extra")]


def test_road_edges_are_cut_at_shared_nodes(spark, tmp_path):
    geo = lambda ids: [{"lat": 12.0 + i / 1000, "lon": 77.0} for i in ids]
    ways = [{"type": "way", "id": w, "nodes": ids, "geometry": geo(ids), "tags": {"highway": c}} for w, ids, c in ((1, [1, 2, 3, 4], "primary"), (2, [9, 3, 8], "primary"), (3, [5, 6], "footway"))]
    (tmp_path / "r.json").write_text(json.dumps({"elements": ways}))
    roads = files.read_roads(spark, str(tmp_path / "r.json"), ["primary"])
    assert sorted(one(files.road_edges(roads), "way", "u", "v")) == [(1, 1, 3), (1, 3, 4), (2, 3, 8), (2, 9, 3)]


def test_truth_track(spark, tmp_path):
    (tmp_path / "t.csv").write_text("t_ns,latitude_deg,longitude_deg,speed_m_s,heading_deg\n0,0.0,0.0,1,2\n1,0.0,0.001,1,\n1,0.0,0.001,1,\n2,0.0,0.002,1,2\n")
    got = one(files.read_truth(spark, str(tmp_path / "t.csv")).orderBy("t_ns"), "t_ns", "distance_m")
    step = math.radians(0.001) * 6_371_000
    assert [t for t, _ in got] == [0, 1, 2] and np.allclose([d for _, d in got], [0, step, 2 * step])


def test_stream_drops_repeated_ids(spark, tmp_path):
    rows = [(1, "a", i, 1_700_000_000 + i, float(i)) for i in (1, 2, 2, 3, 3, 3)]
    df = spark.createDataFrame(rows, "session long, channel string, event_id long, s long, value double").select("session", "channel", "event_id", F.timestamp_seconds("s").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.event_id for r in live.drained(live.intake(stream, delay="1 hour")).collect()) == [1, 2, 3]


def test_every_drive_is_held_out_once(spark, sf):
    from driftline import plans

    plans.load()
    drives = [r.user_id for r in events(spark, sf).select("user_id").collect()]
    want = {}
    for fold in set(drives):
        for u in drives:
            if u != fold:
                want[fold, u % 5] = want.get((fold, u % 5), 0) + 1
    got = [(r.fold, r.grp, r.n) for r in plans.QUERIES["leave_one_out_every_fold"](spark, sf).collect()]
    assert len(got) == len(want) and {(f, g): n for f, g, n in got} == want


def test_steps_carry_their_state_over_batches(spark):
    """A session cut into batches of two rows gives what it gives whole, and a null session is one."""
    draw = np.random.default_rng(3)
    kinds = ["fix", "speed", "stop"]
    rows = [(s, float(i), kinds[i % 3], *map(float, draw.normal(0, 2, 4))) for s in (1, 2**60 + 1, None) for i in range(25)]
    fixes = spark.createDataFrame(rows, "session long, t double, kind string, east double, north double, speed double, heading double")
    turned = fixes.selectExpr("session", "t", "east AS gx", "north AS gy", "1.0D AS gz")
    lattice = fixes.selectExpr("session", "t", "explode(array(1L, 2L, 3L)) AS segment", "east", "north").selectExpr("session", "t", "segment", "segment AS u", "segment + 1 AS v", "-abs(east - segment) AS log_emission", "abs(north) AS travelled_m", "east * segment AS along_m")
    moved = fixes.selectExpr("session", "t / 4 AS t", "east AS fx", "north AS fy", "9.8D AS fz", "speed AS wx", "heading AS wy", "0.1D AS wz")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    out = {}
    try:
        for n in (2, 10_000):
            spark.conf.set(size, n)
            got = sequential.filtered(fixes, "session"), sequential.slips(turned, "session", dwell=1, cooldown=2.0), sequential.viterbi(lattice, "session"), sequential.propagated(moved, "session")
            out[n] = [sorted(map(repr, x.collect())) for x in got]
    finally:
        spark.conf.set(size, before)
    assert out[2] == out[10_000]
    assert [len(x) for x in out[2]][::2] == [75, 75] and len(out[2][3]) == 75 and len(out[2][1]) > 3
    assert any("session=None" in x for x in out[2][0]) and any(f"session={2**60 + 1}" in x for x in out[2][0])
