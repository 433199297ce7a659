"""Networks against plain loops; what a weight file refuses."""

import json
import math

import numpy as np
import pytest

from driftline.operators import inference
from driftline.plans import models


def network(draw):
    d = lambda *n: np.round(draw.normal(0, 0.5, n), 3).tolist()
    return [
        {"kind": "conv", "weight": d(4, 2, 5), "bias": d(4), "stride": 1, "padding": 2}, {"kind": "leaky", "slope": 0.1},
        {"kind": "conv", "weight": d(6, 4, 3), "bias": d(6), "stride": 2, "padding": 1}, {"kind": "leaky", "slope": 0.1}, {"kind": "pool"}, {"kind": "join"},
        {"kind": "scale", "mean": d(15), "scale": [2.0] * 15}, {"kind": "dense", "weight": d(5, 15), "bias": d(5)}, {"kind": "leaky", "slope": 0.0}, {"kind": "dense", "weight": d(2, 5), "bias": d(2)},
    ]


def loops(layers, window, stats):
    """One window, one value at a time."""
    x = [list(c) for c in zip(*window, strict=True)]
    for layer in layers:
        if layer["kind"] == "conv":
            pad, width = layer["padding"], len(layer["weight"][0][0])
            p = [[0.0] * pad + c + [0.0] * pad for c in x]
            x = [[b + sum(f[c][k] * p[c][t + k] for c in range(len(p)) for k in range(width)) for t in range(0, len(p[0]) - width + 1, layer["stride"])] for f, b in zip(layer["weight"], layer["bias"], strict=True)]
        elif layer["kind"] == "leaky":
            one = lambda v, s=layer["slope"]: v if v > 0 else s * v
            x = [[one(v) for v in c] if isinstance(c, list) else one(c) for c in x]
        elif layer["kind"] == "pool":
            x = [sum(c) / len(c) for c in x] + [max(c) for c in x]
        elif layer["kind"] == "join":
            x = x + list(stats)
        elif layer["kind"] == "scale":
            x = [(v - m) / s for v, m, s in zip(x, layer["mean"], layer["scale"], strict=True)]
        else:
            x = [b + sum(a * v for a, v in zip(w, x, strict=True)) for w, b in zip(layer["weight"], layer["bias"], strict=True)]
    return x


def test_outputs_equal_plain_loops(spark):
    draw = np.random.default_rng(2)
    layers = network(draw)
    rows = [(i, draw.normal(size=(int(n), 2)).tolist(), draw.normal(size=3).tolist()) for i, n in enumerate(draw.choice([9, 20, 31], 60))]
    odd = [(100, None, [1.0] * 3), (101, [], [1.0] * 3), (102, [[1.0, 2.0], [1.0]], [1.0] * 3), (103, [[1.0, None]] * 9, [1.0] * 3), (104, rows[0][1], [None, 1.0, 1.0]), (105, rows[0][1], None)]
    df = spark.createDataFrame(rows + odd, "id int, w array<array<double>>, s array<double>").repartition(3)
    got = {r.id: r.output for r in inference.predicted(df, "id", "w", "s", layers).collect()}
    for i, w, s in rows:
        assert np.allclose(got[i], loops(layers, w, s), rtol=1e-9, atol=1e-12)
    assert all(got[i] is None for i, *_ in odd)


def test_a_file_must_be_whole_and_fit(spark, tmp_path):
    layers = network(np.random.default_rng(3))
    inference.write_network(spark, str(tmp_path / "good"), layers)
    assert inference.read_network(spark, str(tmp_path / "good")) == layers
    doc = {"layers": json.loads(json.dumps(layers)), "sha256": inference.digest(layers)}
    doc["layers"][0]["bias"][0] += 1e-9
    (tmp_path / "altered.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="digest"):
        inference.read_network(spark, str(tmp_path / "altered.json"))
    for at, change in ((0, {"bias": [0.0]}), (2, {"weight": [[[1.0]]], "bias": [0.0]}), (9, {"kind": "other"}), (7, {"weight": [[float("nan")] * 15], "bias": [0.0]}), (0, {"stride": 0})):
        bad = json.loads(json.dumps(layers))
        bad[at] |= change
        with pytest.raises(ValueError, match="layer"):
            inference.check(bad)


def test_the_trained_head_is_least_squares(spark, sf):
    rows = models.windows(spark, sf)
    known = rows.filter("y IS NOT NULL").collect()
    x = np.array([loops(models.BANK, r.window, r.stats) + [1.0] for r in known])
    y = np.array([r.y for r in known])
    beta = np.linalg.solve(x.T @ x + 0.01 * np.eye(x.shape[1]), x.T @ y)
    want = {r.event_id: float(np.array(loops(models.BANK, r.window, r.stats) + [1.0]) @ beta) for r in rows.collect()}
    got = {r.event_id: r.next_value for r in models.window_model(spark, sf).collect()}
    assert set(got) == set(want) and len(got) > 50
    assert all(math.isclose(got[k], v, abs_tol=2e-5, rel_tol=1e-5) for k, v in want.items())
    assert len({round(v, 4) for v in got.values()}) > 20
