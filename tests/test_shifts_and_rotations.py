"""Shifted files and distinct rotations, by brute force."""

import numpy as np
import pytest

from driftline.operators import rotation_sets
from driftline.sources import shifts

NAMES = {"Id": "id", "Lat": "lat", "Sat": "sat", "Count": "count", "Time": "time"}
KINDS = {"id": "number", "lat": "number", "sat": "ratio", "count": "number", "time": "datetime"}


def write(tmp_path, name, head, rows):
    p = tmp_path / name
    p.write_text("\n".join([head, *rows]) + "\n")
    return str(p)


def row(k, put=None, sat=None):
    cells = [str(k), "12.5", sat or f" {k % 7} / 9 ", str(k * 2), f"2024-01-01 00:00:{k % 60:02d}:123"]
    if put is not None:
        cells.insert(put, "")
    return ",".join(cells)


@pytest.mark.parametrize("put", [None, 0, 2, 3, 4])
def test_a_file_is_straight_or_shifted_at_one_place(spark, tmp_path, put):
    head = "Id, Lat ,Sat,Count,Time" + ("" if put is None else ",")
    path = write(tmp_path, "a.csv", head, [row(k, put) for k in range(200)])
    got = shifts.read_shifted_csv(spark, path, NAMES, KINDS)
    assert got.columns == ["id", "lat", "sat", "count", "time", "shift"]
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 200 and {r.shift for r in rows.values()} == {put}
    assert (rows["5"].lat, rows["5"].sat.strip(), rows["5"]["count"], rows["5"].time) == ("12.5", "5 / 9", "10", "2024-01-01 00:00:05:123")


def test_what_does_not_fit_is_refused(spark, tmp_path):
    straight, wide = "Id,Lat,Sat,Count,Time", "Id,Lat,Sat,Count,Time,"
    bad = {
        "one odd value far down": (straight, [row(k) for k in range(500)] + [row(501, sat="x")]),
        "shifted for a part of the rows": (wide, [row(k, 2) for k in range(100)] + [row(k, 3) for k in range(100)]),
        "no empty header": (straight + ",Extra", [row(k, 2) for k in range(9)]),
        # of two empty columns either may be the one that was put in
        "ambiguous": ("Id,Lat,Count,", [f"{k},,,7" for k in range(9)]),
    }
    for head, rows in bad.values():
        with pytest.raises(ValueError, match="layouts fit|unknown headers"):
            shifts.layout(spark, write(tmp_path, "b.csv", head, rows), KINDS)


def components(q, tolerance):
    place = list(range(len(q)))
    near = 2 - 2 * np.abs(q @ q.T) <= tolerance**2
    for i in range(len(q)):
        for j in np.flatnonzero(near[i, :i]):
            old, new = max(place[i], place[j]), min(place[i], place[j])
            place = [new if x == old else x for x in place]
    return place


@pytest.mark.parametrize("tolerance", [0.02, 0.15])
def test_distinct_rotations(spark, tolerance):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(700, 4))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[draw.integers(0, 700, 900)] + draw.normal(0, tolerance / 3, (900, 4))
    flat = np.c_[np.zeros(400), draw.normal(0, 0.01, 400), draw.normal(size=(400, 2))]
    q = np.concatenate([base, near, flat]) * draw.choice([-1.0, 1.0, 2.5], 2000)[:, None]
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    want = components(unit, tolerance)
    rows = [(i, x.tolist()) for i, x in enumerate(q)] + [(5000, None), (5001, [0.0] * 4), (5002, [1.0, None, 0.0, 0.0]), (5003, (-q[7]).tolist()), (5004, q[7].tolist())]
    got = {r.id: r.first for r in rotation_sets.distinct_rotations(spark.createDataFrame(rows, "id int, q array<double>").repartition(4), "id", "q", tolerance=tolerance).collect()}
    assert [got[i] for i in range(2000)] == want and len(set(want)) < 2000
    assert got[5000] is got[5001] is got[5002] is None and got[5003] == got[5004] == want[7]
