"""JSON types of the record log, field by field, and encodings of whole files."""

import json

import pytest

from driftline.sources import files, records

GOOD = {
    "imu": {"sensor": "accelerometer", "frame": "android_device", "unit": "m/s^2", "xyz": [0, 1.5, -2e-3], "accuracy": 3},
    "gnss": {"latitude_deg": 12, "longitude_deg": 77.5, "altitude_m": None, "altitude_reference": None, "speed_m_s": 0, "bearing_deg": None, "horizontal_accuracy_m": 4.5, "vertical_accuracy_m": None, "satellites_used": 9, "provider": "gps", "utc_ms": None},
    "gnss_quality": {"state": "good", "fix_age_s": 0.5, "satellites_used": None, "reasons": ["OLD_FIX"]},
    "confidence": {"state": "calibrated", "probability": 1, "horizontal_accuracy_95_m": None, "speed_std_m_s": 2.5},
    "diagnostic": {"severity": "info", "code": "A_1", "message": "text", "dropped_count": 0},
}


def line(kind, data, **event):
    e = {"event_id": "1", "type": kind, "t_ns": "5", "received_ns": "7", "data": data} | {k: v for k, v in event.items() if k in ("event_id", "t_ns", "received_ns", "type")}
    top = {"contract_version": "1.0.0", "session_id": "s", "source": "real", "event": e} | {k: v for k, v in event.items() if k in ("session_id", "source", "contract_version")}
    return json.dumps(top)


def takes(rule, v):
    """What the contract's rule says of a Python value read from JSON."""
    if rule.endswith("?"):
        return v is None or takes(rule[:-1], v)
    number = lambda x: type(x) in (int, float)
    if rule in ("str", "code"):
        return type(v) is str
    if rule == "int":
        return type(v) is int and v < 1 << 63
    if rule == "bool":
        return type(v) is bool
    if rule in ("vec", "quat"):
        return type(v) is list and v != [] and all(map(number, v))
    if rule == "codes":
        return type(v) is list and all(type(x) is str for x in v)
    return number(v)


VALUES = ["x", 1, 1.0, 1.5, True, None, [1, 2], ["a"], [1, "a"], [], {}, {"a": 1}, 10**19, "1"]


def codes(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return {r.line: r.codes for r in records.decoded(df).collect()}


def test_every_field_takes_its_types_alone(spark):
    want = {}
    for kind, data in GOOD.items():
        for name, (_, rule) in records.PAYLOADS[kind].items():
            for v in VALUES:
                want[line(kind, data | {name: v})] = takes(rule, v)
    good = [line(k, d) for k, d in GOOD.items()]
    got = codes(spark, [*want, *good])
    for x, ok in want.items():
        assert ("TYPES" in got[x]) == (not ok), x
    assert all(got[x] == [] for x in good)


@pytest.mark.parametrize("name", ["event_id", "t_ns", "received_ns"])
def test_times_and_ids_are_decimal_strings_from_0(spark, name):
    base = GOOD["gnss"]
    bad = [5, -5, "-5", "05", "5.0", "", None, True, "9" * 20, str(1 << 63), ["5"], " 5"]
    good = ["0", str((1 << 63) - 1)] if name == "event_id" else ["0", "5"] if name == "t_ns" else ["9", str((1 << 63) - 1)]
    got = codes(spark, [line("gnss", base, **{name: v}) for v in [*bad, *good]])
    for v in bad:
        assert got[line("gnss", base, **{name: v})] != [], v
    for v in good:
        assert got[line("gnss", base, **{name: v})] == [], v


def test_header_strings_and_repeated_keys(spark):
    base = GOOD["gnss"]
    numeric = line("gnss", base, session_id=5)
    twice = line("gnss", base).replace('"t_ns": "5"', '"t_ns": "5", "t_ns": "6"')
    message = line("diagnostic", GOOD["diagnostic"] | {"message": 5})
    got = codes(spark, [numeric, twice, message])
    assert "TYPES" in got[numeric] and "JSON" in got[twice] and got[message] == ["TYPES"]


def test_an_encoding_is_what_all_lines_have(spark, tmp_path):
    for name, tail, want in (("u", "é".encode(), "UTF-8"), ("w", b"\xe9\x80", "windows-1252"), ("i", b"\xe9\x81", "ISO-8859-1")):
        p = tmp_path / f"{name}.csv"
        p.write_bytes(b"a,b\n" + b"1,2\n" * 20_000 + b"3," + tail + b"\n")
        assert files.sniffed_encoding(spark, str(p)) == want
        assert files.undecoded(spark, str(p), want).count() == 0
        assert files.undecoded(spark, str(p), "UTF-8").count() == (want != "UTF-8")
        got = files.read_csv(spark, str(p), {"a": "a", "b": "b"})
        assert got.filter("a = 3").first().b[0] == "é"
