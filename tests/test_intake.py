"""The two-clock intake against a plain loop, over several triggers."""

import os

import numpy as np
import pytest

from driftline.streaming import intake, live

SCHEMA = "session long, channel string, event_id long, t_us long, received_us long, admitted_us long, value double, origin_us long, calibrated_us long"


def log(seed, n):
    """Rows of two sessions in the order in which they are offered; some late, stale, repeated, or without a part."""
    draw = np.random.default_rng(seed)
    out = []
    for k in range(n):
        t = 1000 + 10 * k + int(draw.integers(-60, 20))
        offered = 2000 + 10 * k
        pick = draw.random()
        row = [int(draw.integers(2)), str(draw.choice(["a", "b", "c"])), int(draw.integers(0, n)), t, offered - int(draw.integers(0, 130)), offered, 1.0, 1050, 1200]
        if pick < 0.03:
            row[6] = None
        elif pick < 0.06:
            row[2] = None
        elif pick < 0.09:
            row[4] = offered + 5
        elif pick < 0.12:
            row[4] = None
        elif pick < 0.14:
            row[1] = None
        out.append(tuple(row))
    return out


def by_hand(triggers, most_lag, capacity, remember):
    floors, ids, out = {}, {}, []
    for rows in triggers:
        for s in sorted({r[0] for r in rows}):
            taken, newest = 0, 0
            for r in [x for x in rows if x[0] == s]:
                _, c, i, t, received, offered, value, origin, calibrated = r
                newest = max(newest, offered)
                if None in (c, i, t, value) or t < origin:
                    code = "INVALID"
                elif t < calibrated:
                    code = "LATE"
                elif t <= floors.get((s, c), -1) or (s, i) in ids:
                    code = "DUPLICATE"
                else:
                    floors[s, c], ids[s, i] = t, offered
                    if received is not None and not 0 <= offered - received <= most_lag:
                        code = "LATE"
                    elif taken == capacity:
                        code = "DROPPED"
                    else:
                        code, taken = "ACCEPTED", taken + 1
                out.append((s, c, i, t, code))
            if remember is not None:
                for key in [k for k, v in ids.items() if k[0] == s and v < newest - remember]:
                    del ids[key]
    return out, ids


@pytest.mark.parametrize(("capacity", "remember"), [(None, None), (5, 150)])
def test_codes_over_triggers(spark, tmp_path, capacity, remember):
    rows = log(3, 240)
    triggers = [rows[i : i + 60] for i in range(0, 240, 60)]
    for k, part in enumerate(triggers):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    files = [next((tmp_path / f"part{k}").glob("*.parquet")) for k in range(4)]
    (tmp_path / "in").mkdir()
    for k, f in enumerate(files):
        to = tmp_path / "in" / f"{k}.parquet"
        to.write_bytes(f.read_bytes())
        os.utime(to, (1000 + k, 1000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.drained(intake.admitted(stream, most_lag_us=100, capacity=capacity, remember_us=remember)).collect()
    want, ids = by_hand(triggers, 100, capacity, remember)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    codes = {r.code for r in got}
    assert codes >= {"ACCEPTED", "INVALID", "LATE", "DUPLICATE"} and ("DROPPED" in codes) == (capacity is not None)
    assert remember is None or len(ids) < len({(r[0], r[2]) for r in rows}) / 3
