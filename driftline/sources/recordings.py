"""Recordings and experiments on disk, adapters of raw sensor tables, and the live log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import epoch_us, safe_double
from driftline.operators import temporal, validation
from driftline.sources import records

#: What the documents hold that the queries use: fixed names.
METADATA = "recording_id string, session_id string, record_count long, start_ns long, end_ns long, completion string, recovery string"
ANNOTATION = "kind string, session_id string, start_ns long, end_ns long, note string, calibration_id string, motion string, scenario string, gnss_state string"
MASK = "mask_id string, session_id string, description string, provenance string, policy string, intervals array<struct<start_ns:long,end_ns:long,note:string>>, note string"
NAVIGATION = "t_ns long, status string, localization_mode string, latitude_deg double, longitude_deg double, east_m double, north_m double, speed_m_s double, heading_deg double, horizontal_95_m double, calibration_id string"


def _below(spark: SparkSession, root: str, name: str, schema: str, *, lines: bool = True) -> DataFrame:
    """JSON files of one name anywhere below a folder, with the folder that holds each."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    rows = reader.json(root, multiLine=not lines)
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1))


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every recording below a folder, with replayable and exportable flags; payloads are not read."""
    m = _below(spark, root, "metadata.json", METADATA, lines=False)
    replayable = (F.col("completion") == "complete") | (F.col("recovery") == "recovered")
    return m.withColumn("replayable", F.coalesce(replayable, F.lit(False))).withColumn("exportable", F.coalesce(F.col("completion") == "complete", F.lit(False)))


def open_recordings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(accepted records of replayable recordings, findings of every recording)."""
    meta = recordings(spark, root)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "measurements.jsonl*").text(root)
    log = records.decoded(lines)
    keep = meta.filter("replayable").select("session_id")
    return records.accepted(log).join(keep, "session_id", "left_semi"), records.session_findings(log, meta)


def experiments(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Manifests, annotations, masks, sessions and references of every experiment below a folder, found by their ``experiment.json``."""
    manifest = _below(spark, root, "experiment.json", "experiment_id string, sessions array<struct<session_id:string,clock_domain:string,boot_id:string,start_ns:long,end_ns:long>>", lines=False)
    annotations = _below(spark, root, "annotations.jsonl", ANNOTATION)
    masks = _below(spark, root, "mask*.json", MASK, lines=False)
    reference = records.decoded(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "reference.jsonl*").text(root)).filter("type = 'gnss'")
    return {"manifest": manifest, "sessions": manifest.select("folder", "experiment_id", F.inline("sessions")), "annotations": annotations, "masks": masks.select("folder", "mask_id", "session_id", "policy", F.inline("intervals")), "reference": reference}


def experiment_findings(e: dict[str, DataFrame]) -> DataFrame:
    """All findings of all experiments: interval order and bounds, unknown sessions, clocks that do not compare, ids claimed twice."""
    payload = F.concat_ws("|", "calibration_id", "motion", "scenario", "gnss_state")
    ordered = validation.interval_findings(e["annotations"].withColumn("_p", payload).withColumn("_at", F.struct("start_ns", "end_ns")), ["folder", "session_id", "kind"], "_at", "start_ns", "end_ns", "_p")
    one = ordered.select("folder", F.explode("findings").alias("code"), F.col("session_id").alias("what"))
    masks = validation.interval_findings(e["masks"].withColumn("_at", F.struct("start_ns", "end_ns")), ["folder", "mask_id"], "_at", "start_ns", "end_ns", "note")
    two = masks.select("folder", F.explode("findings").alias("code"), F.col("mask_id").alias("what"))
    own = e["sessions"].select("folder", "session_id", F.col("start_ns").alias("a"), F.col("end_ns").alias("b"))
    bound = e["annotations"].join(own, ["folder", "session_id"], "left")
    three = bound.select("folder", F.when(F.col("a").isNull(), "UNKNOWN_SESSION").when((F.col("start_ns") < F.col("a")) | (F.col("end_ns") > F.col("b")), "OUT_OF_BOUNDS").alias("code"), F.col("session_id").alias("what")).filter("code IS NOT NULL")
    clocks = e["sessions"].groupBy("folder").agg(F.countDistinct("clock_domain", "boot_id").alias("n"), F.count("*").alias("k")).filter("n > 1").select("folder", F.lit("CLOCKS").alias("code"), F.col("n").cast("string").alias("what"))
    twice = e["manifest"].groupBy("experiment_id").agg(F.count("*").alias("n"), F.min("folder").alias("folder")).filter("n > 1").select("folder", F.lit("CLAIMED_TWICE").alias("code"), F.col("experiment_id").alias("what"))
    return one.unionByName(two).unionByName(three).unionByName(clocks).unionByName(twice)


def read_navigation(spark: SparkSession, path: str) -> DataFrame:
    """An engine's output: empty fields are null."""
    return spark.read.schema(NAVIGATION).csv(path, header=True, nullValue="")


def imu_samples(raw: DataFrame, session: str) -> DataFrame:
    """Samples of a phone's table (MessageType, utcTimeMillis, elapsedRealtimeNanos, MeasurementX, Y, Z, BiasX, Y, Z): bias taken off, times strictly increasing in each sensor."""
    axis = lambda a: (F.col(f"Measurement{a}") - F.coalesce(F.col(f"Bias{a}"), F.lit(0.0))).alias(a.lower())
    kind = F.when(F.col("MessageType") == "UncalAccel", "accel").when(F.col("MessageType") == "UncalGyro", "gyro")
    rows = raw.select(session, kind.alias("sensor"), F.col("elapsedRealtimeNanos").alias("t_ns"), *map(axis, "XYZ")).filter("sensor IS NOT NULL")
    # one of each time: of equal ones the smallest values
    k = F.row_number().over(Window.partitionBy(session, "sensor", "t_ns").orderBy("x", "y", "z"))
    return rows.withColumn("_k", k).filter("_k = 1").drop("_k")


def external_imu(raw: DataFrame, session: str, *, g: float = 9.80665, degrees: bool = True) -> DataFrame:
    """Rows of a bare sensor table (t_s, ax, ay, az in g, gx, gy, gz, optional lat, lon, speed_m_s, course_deg) as sensor rows.

    Each input row makes an accelerometer and a gyro row and, where it has a
    position, a fix, numbered in this order by time; rows that do not come later than the one before go.
    """
    missing = sorted({"t_s", "ax", "ay", "az", "gx", "gy", "gz"} - set(raw.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    rate = F.lit(0.017453292519943295 if degrees else 1.0)
    has = "lat" in raw.columns and "lon" in raw.columns
    rows = raw.withColumn("t_ns", F.bround(F.col("t_s") * 1e9, 0).cast("long")).withColumn("_at", F.monotonically_increasing_id())
    rows = temporal.strictly_increasing(rows, [session], "_at", "t_ns")
    sample = lambda k, kind, xyz: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.array(*xyz).alias("v"))
    parts = [sample(0, "accel", [F.col(c) * g for c in ("ax", "ay", "az")]), sample(1, "gyro", [F.col(c) * rate for c in ("gx", "gy", "gz")])]
    if has:
        fix = [F.col("lat"), F.col("lon"), *(F.col(c) if c in raw.columns else F.lit(None).cast("double") for c in ("speed_m_s", "course_deg"))]
        parts.append(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), sample(2, "fix", fix)))
    out = rows.select(session, "t_ns", F.inline(F.array_compact(F.array(*parts))))
    return out.withColumn("event_id", F.row_number().over(Window.partitionBy(session).orderBy("t_ns", "k")).cast("long")).drop("k")


def elapsed(raw: DataFrame, session: str, order: str, text: str, fmt: str = "yyyy-MM-dd HH:mm:ss:SSS") -> DataFrame:
    """``elapsed_s`` of wall-clock texts since the session's first valid one; unreadable ones are null."""
    rows = raw.withColumn("_ts", F.expr(f"try_to_timestamp({text}, '{fmt}')").cast("timestamp_ntz"))
    rows = rows.withColumn("_us", epoch_us("_ts"))
    first = F.first("_us", ignorenulls=True).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("elapsed_s", (F.col("_us") - first) / F.lit(1e6)).drop("_ts", "_us")


def unit_scale(pairs: DataFrame, keys: list[str], reported: str, derived: str, *, slack: float = 0.2) -> DataFrame:
    """The factor that makes a reported speed metres per second: 1, 1 / 3.6, or null where the median ratio says neither."""
    ratio = pairs.filter(F.col(derived) > 1).groupBy(*keys).agg(F.percentile(F.col(reported) / F.col(derived), 0.5).alias("ratio"))
    near = lambda x: F.abs(F.col("ratio") / x - 1) <= slack
    return ratio.withColumn("scale", F.when(near(1.0), F.lit(1.0)).when(near(3.6), F.lit(1 / 3.6)))


def numbers(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as finite doubles, null where they are none."""
    return raw.withColumns({c: safe_double(c) for c in columns})


def live_log(spark: SparkSession, path: str, *, files: int = 1) -> DataFrame:
    """The log as a stream of decoded records, some files at a time."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return records.decoded(lines)
