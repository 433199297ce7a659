"""Recordings, experiments and adapters on small files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from driftline import plans
from driftline.operators import calibration
from driftline.plans import audits
from driftline.sources import recordings, records
from driftline.sources.tables import events
from driftline.streaming import live

plans.load()


@pytest.fixture(scope="module")
def log(spark, sf, tmp_path_factory):
    """Three recordings of one session each; the third has no end."""
    root = tmp_path_factory.mktemp("rec")
    recs = audits.as_records(events(spark, sf)).filter("gnss.bearing_deg < 360 AND session_id IN ('s1', 's2', 's3')")
    for s in ("s1", "s2", "s3"):
        own = recs.filter(F.col("session_id") == s)
        lines = [r.value for r in own.orderBy("t_ns").transform(records.encoded).collect()]
        span = own.agg(F.min("t_ns"), F.max("received_ns")).first()
        (root / s).mkdir()
        (root / s / "measurements.jsonl").write_text("\n".join(lines) + "\n")
        n = len(lines) + (s == "s2")
        (root / s / "metadata.json").write_text(json.dumps({"recording_id": "r" + s, "session_id": s, "record_count": n, "start_ns": span[0], "end_ns": span[1], "completion": "open" if s == "s3" else "complete", "recovery": None}))
    return root, recs


def test_open_recordings(spark, log):
    root, recs = log
    got, findings = recordings.open_recordings(spark, str(root))
    assert got.count() == recs.filter("session_id <> 's3'").count()
    assert {r.session_id: r.codes for r in findings.collect()} == {"s1": [], "s2": ["COUNT"], "s3": []}
    assert {r.session_id: (r.replayable, r.exportable) for r in recordings.recordings(spark, str(root)).collect()} == {"s1": (True, True), "s2": (True, True), "s3": (False, False)}


def test_live_log_is_the_batch_log(spark, log):
    root, recs = log
    stream = recordings.live_log(spark, f"{root}/*/measurements.jsonl").select("session_id", "event_id", "t_ns")
    assert sorted(live.drained(stream).collect()) == sorted(recs.select("session_id", "event_id", "t_ns").collect())


def test_experiments(spark, tmp_path):
    for name, extra in (("a", []), ("b", [("x", 5, 50)])):
        d = tmp_path / name
        d.mkdir()
        (d / "experiment.json").write_text(json.dumps({"experiment_id": "e1", "sessions": [{"session_id": "x", "clock_domain": "boot", "boot_id": "1", "start_ns": 0, "end_ns": 40}]}))
        rows = [("x", 0, 10), ("x", 10, 20), *extra]
        (d / "annotations.jsonl").write_text("\n".join(json.dumps({"kind": "motion", "session_id": s, "start_ns": a, "end_ns": b, "motion": str(a)}) for s, a, b in rows))
        (d / "mask1.json").write_text(json.dumps({"mask_id": "m", "session_id": "x", "policy": "drop", "intervals": [{"start_ns": 1, "end_ns": 3}, {"start_ns": 2, "end_ns": 4}]}))
    e = recordings.experiments(spark, str(tmp_path))
    got = sorted((r.folder[-1], r.code) for r in recordings.experiment_findings(e).collect())
    assert got == [("a", "CLAIMED_TWICE"), ("a", "OVERLAP"), ("b", "OUT_OF_BOUNDS"), ("b", "OVERLAP"), ("b", "OVERLAP"), ("b", "OVERLAP")]


def test_external_imu(spark):
    raw = spark.createDataFrame([("s", 0.0, 1.0, 0.0, 0.0, 180.0, 0.0, 0.0, 1.0, 2.0), ("s", 0.0, 9.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None), ("s", 0.01, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, None, None)], "s string, t_s double, ax double, ay double, az double, gx double, gy double, gz double, lat double, lon double").coalesce(1)
    got = recordings.external_imu(raw, "s").orderBy("event_id").collect()
    assert [(r.event_id, r.kind, r.t_ns) for r in got] == [(1, "accel", 0), (2, "gyro", 0), (3, "fix", 0), (4, "accel", 10_000_000), (5, "gyro", 10_000_000)]
    assert math.isclose(got[0].v[0], 9.80665) and math.isclose(got[1].v[0], math.pi)
    with pytest.raises(ValueError, match="missing"):
        recordings.external_imu(raw.drop("gz"), "s")


def test_elapsed_and_units(spark):
    raw = spark.createDataFrame([("s", 1, "bad"), ("s", 2, "2020-01-01 00:00:01:500"), ("s", 3, "2020-01-01 00:00:03:000")], "s string, i int, w string")
    assert [r.elapsed_s for r in recordings.elapsed(raw, "s", "i", "w").orderBy("i").collect()] == [None, 0.0, 1.5]
    pairs = spark.createDataFrame([("kmh", 36.0, 10.0), ("ms", 10.2, 10.0), ("none", 20.0, 10.0)], "k string, a double, b double")
    assert {r.k: r.scale for r in recordings.unit_scale(pairs, ["k"], "a", "b").collect()} == {"kmh": 1 / 3.6, "ms": 1.0, "none": None}


def test_phone_samples(spark):
    raw = spark.createDataFrame([("s", "UncalAccel", 1, 1.0, 0.0, 0.0, None), ("s", "UncalAccel", 1, 2.0, 0.0, 0.0, None), ("s", "UncalGyro", 1, 1.0, 0.0, 0.0, 0.25), ("s", "Other", 1, 0.0, 0.0, 0.0, None)], "s string, MessageType string, elapsedRealtimeNanos long, MeasurementX double, MeasurementY double, MeasurementZ double, BiasX double").withColumn("BiasY", F.lit(None).cast("double")).withColumn("BiasZ", F.lit(0.0))
    assert sorted((r.sensor, r.x) for r in recordings.imu_samples(raw, "s").collect()) == [("accel", 1.0), ("gyro", 0.75)]


def test_doppler_velocity(spark):
    import numpy as np

    draw = np.random.default_rng(0)
    rows = []
    for e in range(3):
        u = draw.normal(size=(8, 3))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        rate = -u @ np.array([1.0, 2.0, 3.0]) + 0.5
        rate[0] += 100 * (e == 1)
        rows += [(e, *map(float, v), float(r), 1.0) for v, r in zip(u, rate, strict=True)]
    rows.append((9, 1.0, 0.0, 0.0, 1.0, 1.0))
    got = {r.e: r for r in calibration.doppler_velocity(spark.createDataFrame(rows, "e int, ux double, uy double, uz double, rate double, weight double"), ["e"]).collect()}
    assert got[9].vx is None and all(abs(got[e].vz - 3) < 1e-6 and abs(got[e].drift - 0.5) < 1e-6 for e in (0, 2))


def test_nearest_rotation(spark):
    import numpy as np

    df = spark.createDataFrame([(1, [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, -2.0]]), (2, [[0.0, -3.0, 0.0], [3.0, 0.0, 0.0], [0.0, 0.0, 3.0]])], "k int, m array<array<double>>")
    got = {r.k: np.array(r.rotation) for r in calibration.nearest_rotation(df, "k", "m").collect()}
    assert all(np.isclose(np.linalg.det(m), 1) and np.allclose(m @ m.T, np.eye(3)) for m in got.values()) and np.allclose(got[2], [[0, -1, 0], [1, 0, 0], [0, 0, 1]])


def doppler_by_hand(d, gate=3.0, condition=1e4):
    """vx, vy, vz, drift (or None) and the rows used of one epoch's (ux, uy, uz, rate, weight)."""
    import numpy as np

    d = np.array(d, float)
    a, y, w = np.c_[-d[:, :3], np.ones(len(d))], d[:, 3], np.sqrt(d[:, 4])
    use, x = np.ones(len(d), bool), None
    for _ in range(2):
        if use.sum() < 4 or np.linalg.cond(a[use] * w[use, None]) > condition:
            return None, int(use.sum())
        x = np.linalg.lstsq(a[use] * w[use, None], y[use] * w[use], rcond=None)[0]
        res = y - a @ x
        mid = np.median(res[use])
        use = np.abs(res - mid) <= gate * max(1.4826 * np.median(np.abs(res[use] - mid)), 1e-6)
    return x, int(use.sum())


def test_doppler_solve_has_every_order(spark, sf):
    import numpy as np

    lines = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        n, p = r.l_linenumber, r.l_partkey % 13
        lines.setdefault(r.l_orderkey, []).append([math.sin(n + p), math.sin(2 * n + p), math.sin(3 * n + p), float(r.l_quantity) / 10, 1 + float(r.l_discount)])
    got = {r.l_orderkey: r for r in plans.QUERIES["doppler_solve"](spark, sf).collect()}
    assert set(got) == set(lines)
    solved = 0
    for k, d in lines.items():
        x, used = doppler_by_hand(d)
        mine = [got[k].vx, got[k].vy, got[k].vz, got[k].drift]
        assert got[k].n_used == used
        assert mine == [None] * 4 if x is None else np.allclose(mine, x, rtol=1e-6, atol=1e-6)
        solved += x is not None
    assert solved > 100
