"""The record log: one JSON object per line, read strictly, written canonically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import validation

VERSIONS = ("1.0.0", "1.1.0")
MOST_BYTES = 65_536

#: Payload fields and their rules, by type, in the order of the wire: fixed values.
PAYLOADS: dict[str, dict[str, tuple[str, str]]] = {
    "imu": {"sensor": ("string", "str"), "frame": ("string", "str"), "unit": ("string", "str"), "xyz": ("array<double>", "vec"), "accuracy": ("long", "int")},
    "gnss": {
        "latitude_deg": ("double", "lat"), "longitude_deg": ("double", "lon"), "altitude_m": ("double", "num?"), "altitude_reference": ("string", "str?"), "speed_m_s": ("double", "nonneg?"), "bearing_deg": ("double", "heading?"),
        "horizontal_accuracy_m": ("double", "nonneg?"), "vertical_accuracy_m": ("double", "nonneg?"), "satellites_used": ("long", "int?"), "provider": ("string", "str"), "utc_ms": ("long", "int?"),
    },
    "calibration": {
        "id": ("string", "str"), "status": ("string", "str"), "q_vehicle_from_device_wxyz": ("array<double>", "quat?"), "gyro_bias_rad_s": ("array<double>", "vec?"), "accelerometer_bias_m_s2": ("array<double>", "vec?"), "confidence": ("double", "prob?"),
    },
    "navigation": {
        "status": ("string", "str"), "initialization_mode": ("string", "str"), "origin_wgs84_deg_m": ("array<double>", "vec?"), "position_enu_m": ("array<double>", "vec?"), "velocity_enu_m_s": ("array<double>", "vec?"), "q_enu_from_vehicle_wxyz": ("array<double>", "quat?"),
        "heading_deg": ("double", "heading?"), "calibration_id": ("string", "str?"), "gnss_used_after_initialization": ("boolean", "bool"),
    },
    "gnss_quality": {"state": ("string", "str"), "fix_age_s": ("double", "nonneg?"), "satellites_used": ("long", "int?"), "reasons": ("array<string>", "codes")},
    "confidence": {"state": ("string", "str"), "probability": ("double", "prob?"), "horizontal_accuracy_95_m": ("double", "nonneg?"), "speed_std_m_s": ("double", "nonneg?")},
    "diagnostic": {"severity": ("string", "str"), "code": ("string", "code"), "message": ("string", "str"), "dropped_count": ("long", "int")},
}

ENVELOPE = ("contract_version", "session_id", "source", "event")
EVENT = ("event_id", "type", "t_ns", "received_ns", "data")


def schema(kind: str) -> str:
    return ", ".join(f"{n} {t}" for n, (t, _) in PAYLOADS[kind].items())


def _keys(doc: Column, expected: tuple[str, ...]) -> Column:
    """Exactly these keys, none missing and none more."""
    k = F.json_object_keys(doc)
    return (F.size(k) == len(expected)) & (F.size(F.array_except(k, F.array(*map(F.lit, expected)))) == 0)


#: JSON types that a rule takes, as VARIANT names them: a number is no string, 1.0 is no integer, and what is beyond 64 bits is a decimal.
JSON_TYPES = {
    "str": "STRING", "code": "STRING", "int": "BIGINT", "bool": "BOOLEAN", "vec": r"ARRAY<(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>", "quat": r"ARRAY<(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>", "codes": "ARRAY<(STRING|VOID)>",
    "num": r"BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)",
}

#: A whole number from 0 that 64 bits hold, as a string.
DECIMAL = "^(0|[1-9][0-9]{0,18})$"


def _typed(path: str, rule: str) -> Column:
    """Whether the value at a path of the VARIANT column ``_v`` has a JSON type that the rule takes."""
    kind = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    ok = kind.rlike(f"^({JSON_TYPES.get(rule.rstrip('?'), JSON_TYPES['num'])})$")
    return F.coalesce(ok | (kind == "VOID") if rule.endswith("?") else ok, F.lit(False))


def _types_hold() -> Column:
    """Every value of the envelope, the event and the payload has its JSON type."""
    ok = F.lit(True)
    for path in ("$.contract_version", "$.session_id", "$.source", "$.event.event_id", "$.event.type", "$.event.t_ns", "$.event.received_ns"):
        ok = ok & _typed(path, "str")
    payload = F.lit(False)
    for kind, fields in PAYLOADS.items():
        all_hold = F.lit(True)
        for name, (_, rule) in fields.items():
            all_hold = all_hold & _typed(f"$.event.data.{name}", rule)
        payload = F.when(F.col("type") == kind, all_hold).otherwise(payload)
    return ok & payload


def decoded(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of text lines: envelope, one struct for each payload type, and ``codes`` of what is wrong.

    Keys must match exactly and occur once; every value must have its JSON type; 64-bit integers
    are decimal strings from 0; NaN and Infinity are no numbers. A wrong line stays, with its codes and its text.
    """
    line = F.col(value)
    get = lambda path: F.get_json_object(line, path)
    long = lambda path: F.when(get(path).rlike(DECIMAL), get(path).try_cast("long"))
    rows = lines.select(
        line.alias("line"), get("$.contract_version").alias("contract_version"), get("$.session_id").alias("session_id"), get("$.source").alias("source"),
        long("$.event.event_id").alias("event_id"), get("$.event.type").alias("type"), long("$.event.t_ns").alias("t_ns"), long("$.event.received_ns").alias("received_ns"), get("$.event.data").alias("_data"), F.try_parse_json(line).alias("_v"),
    )
    options = {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}
    for kind in PAYLOADS:
        rows = rows.withColumn(kind, F.when(F.col("type") == kind, F.from_json("_data", schema(kind), options)))
    broken = {
        "SIZE": F.octet_length("line") <= MOST_BYTES,
        "JSON": F.col("_v").isNotNull() & _keys(F.col("line"), ENVELOPE) & _keys(F.get_json_object("line", "$.event"), EVENT),
        "VERSION": F.col("contract_version").isin(*VERSIONS),
        "HEADER": validation.rule("str", F.col("session_id")) & validation.rule("str", F.col("source")),
        "EVENT_ID": F.col("event_id").isNotNull(),
        "TIME": F.col("received_ns") >= F.col("t_ns"),
        "TYPE": F.col("type").isin(*PAYLOADS),
        "TYPES": _types_hold(),
        "FIELDS": _fields_match(),
        "VALUES": _values_hold(),
    }
    return rows.withColumn("codes", validation.errors(broken)).drop("_data", "_v")


def _fields_match() -> Column:
    ok = F.lit(False)
    for kind, fields in PAYLOADS.items():
        named = tuple(fields)
        exact = _keys(F.col("_data"), named)
        if kind == "navigation":
            # one more field, in the newer version alone
            newer = F.col("contract_version") == VERSIONS[1]
            exact = (~newer & exact) | (newer & _keys(F.col("_data"), (*named, "localization_mode")))
        ok = F.when(F.col("type") == kind, exact).otherwise(ok)
    return ok


def _values_hold() -> Column:
    ok = F.lit(False)
    for kind, fields in PAYLOADS.items():
        all_hold = F.lit(True)
        for name, (_, rule) in fields.items():
            all_hold = all_hold & validation.rule(rule, F.col(kind)[name])
        ok = F.when(F.col("type") == kind, all_hold).otherwise(ok)
    gnss = F.col("gnss")
    pair = (F.col("type") != "gnss") | (gnss["altitude_m"].isNull() == gnss["altitude_reference"].isNull())
    return ok & pair


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSONL files, plain or gzip; see :func:`decoded`."""
    return decoded(spark.read.text(path))


def encoded(records: DataFrame) -> DataFrame:
    """Canonical lines (column value) of decoded records."""
    data = F.coalesce(*[F.when(F.col("type") == k, F.to_json(k, {"ignoreNullFields": "false"})) for k in PAYLOADS])
    q = lambda c: F.to_json(F.array(F.col(c)))
    text = lambda c: F.substring(q(c), F.lit(2), F.length(q(c)) - 2)
    number = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    pieces = ['{"contract_version":', text("contract_version"), ',"session_id":', text("session_id"), ',"source":', text("source"), ',"event":{"event_id":', number("event_id"), ',"type":', text("type"), ',"t_ns":', number("t_ns"), ',"received_ns":', number("received_ns"), ',"data":', data, "}}"]
    return records.select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]).alias("value"))


def write_records(records: DataFrame, path: str, *, files: int | None = None) -> None:
    """JSONL files, each in the order of session and event."""
    parts = records.repartition(files or 1, "session_id") if files else records.repartition("session_id")
    encoded(parts.sortWithinPartitions("session_id", "event_id")).write.text(path)


def accepted(records: DataFrame) -> DataFrame:
    return records.filter(F.size("codes") == 0).drop("codes", "line")


def rejected(records: DataFrame) -> DataFrame:
    return records.filter(F.size("codes") > 0).select("line", "codes")


def session_findings(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per session: what the log says against its metadata (session_id, record_count, start_ns, end_ns)."""
    w = Window.partitionBy("session_id").orderBy("event_id")
    seen = records.withColumn("_newest", F.max("received_ns").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    n = seen.groupBy("session_id").agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("event_id")).alias("n_repeated"), F.min("t_ns").alias("first_ns"), F.max("received_ns").alias("last_ns"),
        F.countDistinct("source").alias("n_sources"), F.count_if(F.col("received_ns") < F.col("_newest")).alias("n_back"),
    )
    both = metadata.join(n, "session_id", "full_outer")
    checks = {
        "NO_LOG": F.col("n").isNotNull(), "NO_METADATA": F.col("record_count").isNotNull(), "COUNT": F.col("n") == F.col("record_count"), "REPEATED_ID": F.col("n_repeated") == 0,
        "BEFORE_START": F.col("first_ns") >= F.col("start_ns"), "AFTER_END": F.col("last_ns") <= F.col("end_ns"), "SOURCES": F.col("n_sources") == 1,
    }
    return both.select("session_id", "n", "n_back", validation.errors(checks).alias("codes"))


def merged_log(imu: DataFrame, fixes: DataFrame) -> DataFrame:
    """Two record tables as one, numbered by time in each session, IMU first on ties."""
    both = imu.withColumn("_kind", F.lit(0)).unionByName(fixes.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("t_ns", "_kind"))
    return both.withColumn("event_id", n.cast("long")).drop("_kind")


#: The empty frame's type, for tests and streams.
LINE = T.StructType([T.StructField("value", T.StringType())])
