"""Hashes, text keys, codecs, profiles of whole tables, road geometry and exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import rotations
from driftline.functions.scalars import group_key, half_even as r, hash_mod3, header_key, leading_count
from driftline.operators import rotation_sets
from driftline.sources import files, records, shifts
from driftline.sources.storage import shared_path
from driftline.sources.tables import events, table

from . import query
from .tracks import segments


@query("""-- documents
SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS n_chars FROM documents""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"))


@query("""-- customer
SELECT c_custkey, (sum(strpos('0123456789abcdef', substr(sha256(c_name), i, 1)) - 1) % 3)::INT AS fold FROM customer, (SELECT unnest(range(1, 65)) AS i) GROUP BY c_custkey""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha256(name) mod 3 as the held-out split."""
    return table(spark, sf_dir, "customer").select("c_custkey", hash_mod3(F.col("c_name")).cast("int").alias("fold"))


@query("""-- part
SELECT p_partkey, regexp_replace(p_brand || p_type, '([0-9])[A-Za-z]+$', '\\1') AS grp, lower(trim(regexp_replace('  ' || p_name || '  ' || p_type, '\\s+', ' ', 'g'))) AS header,
  CASE WHEN regexp_full_match(trim(string_split((p_size)::VARCHAR || ' / 50', '/')[1]), '[0-9]+') THEN trim(string_split((p_size)::VARCHAR || ' / 50', '/')[1])::INT END AS used FROM part""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group keys, normalised headers and counts out of text."""
    ratio = F.concat(F.col("p_size").cast("string"), F.lit(" / 50"))
    label = F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", group_key(F.concat("p_brand", "p_type")).alias("grp"), header_key(label).alias("header"), leading_count(ratio).alias("used"))


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS n_not_numeric, min(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS low, max(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS high,
  count(DISTINCT props) AS n_distinct FROM ev GROUP BY event_type""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, unreadable, extreme and distinct values of a text column."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k.isNull()).alias("n_not_numeric"), F.min(k).alias("low"), F.max(k).alias("high"), F.countDistinct("props").alias("n_distinct"))


@query("""-- documents
SELECT sha256(text) AS sha256, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with equal content. Counts come first, so that only groups of two or more are listed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    twice = rows.groupBy("sha256").agg(F.count("*").alias("n")).filter("n > 1")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return rows.join(twice, "sha256").groupBy("sha256", "n").agg(ids.alias("members"))


@query()
def record_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, written as canonical lines, read back strictly: what comes back, and its codes."""
    lines = records.encoded(as_records(events(spark, sf_dir)))
    back = records.decoded(lines)
    return back.select("session_id", "event_id", "type", "t_ns", "gnss", F.array_join("codes", ";").alias("codes"))


#: What each seventh of the lines has wrong, and how a line gets it.
DEFECTS = (
    ("", None, None),
    ("TYPES", r'"t_ns":"(\d+)"', '"t_ns":$1'),
    ("TIME", r'"t_ns":"(\d+)"', '"t_ns":"-$1"'),
    ("TYPES", r'"session_id":"s(\d+)"', '"session_id":$1'),
    ("TIME", r'"received_ns":"(\d+)"', '"received_ns":"9$1"'),
    ("TYPES", r'"longitude_deg":([0-9.]+)', '"longitude_deg":"$1"'),
    ("TYPES", '"satellites_used":null', '"satellites_used":7.0'),
)


@query("""
, x AS (SELECT *, event_id % 7 AS k FROM ev)
SELECT event_id, CASE WHEN k IN (1, 3, 5, 6) THEN 'TYPES' WHEN k IN (2, 4) THEN 'TIME' ELSE '' END || CASE WHEN event_type = 'error' OR k = 5 THEN CASE WHEN k = 0 THEN 'VALUES' ELSE ';VALUES' END ELSE '' END AS codes FROM x""")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a wrong JSON type, a negative time or one beyond 64 bits, and the codes that they get."""
    recs = as_records(events(spark, sf_dir))
    lines = records.encoded(recs)
    k = F.get_json_object("value", "$.event.event_id").cast("long")
    value = F.col("value")
    for n, (_, was, now) in enumerate(DEFECTS):
        if was:
            value = F.when(k % len(DEFECTS) == n, F.regexp_replace("value", was, now)).otherwise(value)
    back = records.decoded(lines.select(value.alias("value")))
    return back.select("event_id", F.array_join("codes", ";").alias("codes"))


def as_records(ev: DataFrame) -> DataFrame:
    """Events as GNSS records: the errors have a bearing out of range."""
    fields = {n: F.lit(None).cast(t) for n, (t, _) in records.PAYLOADS["gnss"].items()}
    fields |= {"latitude_deg": F.col("lat"), "longitude_deg": F.col("lon"), "speed_m_s": F.col("value"), "bearing_deg": F.when(F.col("event_type") == "error", F.lit(400.0)).otherwise(F.col("bearing")), "provider": F.lit("gps")}
    rows = ev.select(F.lit("1.0.0").alias("contract_version"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.lit("replay").alias("source"), "event_id", F.lit("gnss").alias("type"), (F.col("t_us") * 1000).alias("t_ns"), (F.col("t_us") * 1000 + 5).alias("received_ns"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("gnss"))
    for kind in records.PAYLOADS:
        if kind != "gnss":
            rows = rows.withColumn(kind, F.lit(None).cast("struct<" + ",".join(f"{n}:{t}" for n, (t, _) in records.PAYLOADS[kind].items()) + ">"))
    return rows


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_rejected FROM ev GROUP BY user_id""")
def record_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session's records, how many the strict reader rejects."""
    back = records.decoded(records.encoded(as_records(events(spark, sf_dir))))
    return back.groupBy(F.substring("session_id", 2, 20).cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.count_if(F.size("codes") > 0).alias("n_rejected"))


@query("""-- nation
WITH seg AS (SELECT n_nationkey * 8 + k AS segment, round_even((12.9::DOUBLE + ((n_nationkey * 41 + k * 17) % 100) / 1000::DOUBLE) * 1e6, 0)::BIGINT AS a, round_even((77.5::DOUBLE + ((n_nationkey * 59 + k * 23) % 100) / 1000::DOUBLE) * 1e6, 0)::BIGINT AS b,
  round_even((12.9::DOUBLE + ((n_nationkey * 41 + k * 17) % 100 + k % 3 + 1) / 1000::DOUBLE) * 1e6, 0)::BIGINT AS c, round_even((77.5::DOUBLE + ((n_nationkey * 59 + k * 23) % 100 + n_nationkey % 4) / 1000::DOUBLE) * 1e6, 0)::BIGINT AS d FROM nation, (SELECT unnest(range(8)) AS k))
SELECT segment, a || ',' || b || ' ' || (c - a) || ',' || (d - b) AS deltas, true AS exact FROM seg""")
def delta_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines as micro-degree differences, and back."""
    s = segments(spark, sf_dir).withColumn("points", F.array(F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))))
    s = s.withColumn("d", files.micro(F.col("points"))).withColumn("back", files.degrees(F.col("d")))
    same = F.forall(F.zip_with("points", "back", lambda p, q: (F.abs(p["lat"] - q["lat"]) < 1e-6) & (F.abs(p["lon"] - q["lon"]) < 1e-6)), lambda x: x)
    return s.select("segment", F.array_join(F.transform("d", lambda x: F.concat(x["lat"].cast("string"), F.lit(","), x["lon"].cast("string"))), " ").alias("deltas"), same.alias("exact"))


@query()
def track_kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.kml(events(spark, sf_dir).select("user_id", "t_us", "lat", "lon"), "user_id", "t_us")


@query()
def track_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.gpx(events(spark, sf_dir).select("user_id", "t_us", "lat", "lon"), "user_id", "t_us")


@query("""-- embeddings
SELECT label, count(*) AS n, round_even(avg(m), 4) AS mean, round_even(avg(q), 4) AS mean_norm
FROM (SELECT vec_id, label, avg(x::DOUBLE) AS m, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS q FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings) GROUP BY ALL) GROUP BY label""")
def window_tensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of fixed-length windows kept as arrays."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), r(F.avg(total / F.size("embedding")), 4).alias("mean"), r(F.avg(F.sqrt(square)), 4).alias("mean_norm"))


@query()
def mlp_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small network over each window: standardise, two tanh layers, a linear one; weights from a fixed seed stand in for a file."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(dtype=float)
        m = np.stack(x.to_numpy()).astype(float)
        h = (m - m.mean(axis=1, keepdims=True)) / (m.std(axis=1, keepdims=True) + 1e-9)
        for a in layers(m.shape[1]):
            h = np.tanh(h @ a)
        return pd.Series(h.sum(axis=1))

    def layers(n: int) -> list[np.ndarray]:
        g = np.random.default_rng(0)
        return [g.normal(size=(n, 16)) / n**0.5, g.normal(size=(16, 8)) / 4]

    return table(spark, sf_dir, "embeddings").select("vec_id", r(run("embedding"), 5).alias("y"))


@query("""
, l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS k, value FROM ev WHERE event_type = 'view'),
r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS k, value FROM ev WHERE event_type = 'click')
SELECT user_id, count(*) AS n, round_even(avg(l.value - r.value), 6) AS mean, round_even(sqrt(avg(pow(l.value - r.value, 2))), 6) AS rmse, round_even(max_by(l.value - r.value, k), 6) AS final FROM l JOIN r USING (user_id, k) GROUP BY user_id""")
def same_row_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams compared row by row."""
    ev = events(spark, sf_dir).select("user_id", "event_type", "t_us", "event_id", "value")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id"))
    one = lambda kind, name: ev.filter(F.col("event_type") == kind).select("user_id", k.alias("k"), F.col("value").alias(name))
    d = F.col("a") - F.col("b")
    return one("view", "a").join(one("click", "b"), ["user_id", "k"]).groupBy("user_id").agg(F.count("*").alias("n"), r(F.avg(d)).alias("mean"), r(F.sqrt(F.avg(d * d))).alias("rmse"), r(F.max_by(d, "k")).alias("final"))


@query("""
, a AS (SELECT user_id, event_type, value FROM ev WHERE event_id % 3 <> 0), b AS (SELECT user_id, event_type, value FROM ev WHERE event_id % 3 <> 1)
SELECT user_id, event_type, value FROM a EXCEPT ALL SELECT user_id, event_type, value FROM b""")
def prefix_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one stream has and the other has not, rows counted."""
    ev = events(spark, sf_dir)
    pick = lambda k: ev.filter(F.col("event_id") % 3 != k).select("user_id", "event_type", "value")
    return pick(0).exceptAll(pick(1))


#: Headers of a phone's log and the kinds of their values.
PHONE = {"Id": "number", "Latitude": "number", "Speed": "number", "Satellites": "ratio", "Counter": "number", "Time": "datetime"}


@query("""
SELECT event_id::VARCHAR AS id, (event_id % 90)::VARCHAR AS latitude, value::VARCHAR AS speed, (event_id % 9) || ' / ' || (event_id % 9 + 5) AS satellites, (event_id % 1000)::VARCHAR AS counter, strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S') AS time, 3 AS shift FROM ev""")
def shifted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose values stand one column off from the fourth on, written, recognised by what its columns hold, and read in place."""
    ev = events(spark, sf_dir)
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    ratio = F.concat_ws(" / ", text(k % 9), text(k % 9 + 5))
    time = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss")
    values = (text(k), text(k % 90), text(F.col("value")), F.lit(""), ratio, text(k % 1000), time)
    path = shared_path(spark, "shifted")
    ev.select(*[c.alias(h) for c, h in zip(values, [*PHONE, " "], strict=True)]).write.csv(path, header=True, emptyValue="")
    return shifts.read_shifted_csv(spark, path, {h: h.lower() for h in PHONE}, PHONE)


ROTATION = """-- part
WITH p AS (SELECT p_partkey AS part, p_partkey % 120 AS k, radians((p_partkey * 13) % 40 * 9) + (p_partkey // 120) % 3 * 0.0016::DOUBLE AS angle, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS s, ((p_partkey * 7) % 5 - 2)::DOUBLE AS x, ((p_partkey * 11) % 5 - 2)::DOUBLE AS y, (1 + p_partkey % 3)::DOUBLE AS z FROM part),
q AS MATERIALIZED (SELECT part, s * cos(angle / 2) AS w, s * sin(angle / 2) * x / sqrt(x * x + y * y + z * z) AS x, s * sin(angle / 2) * y / sqrt(x * x + y * y + z * z) AS y, s * sin(angle / 2) * z / sqrt(x * x + y * y + z * z) AS z FROM p),
e AS MATERIALIZED (SELECT a.part AS a, b.part AS b FROM q a JOIN q b ON 2 - 2 * abs(a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z) <= 1e-6),
m1 AS MATERIALIZED (SELECT a, min(b) AS m FROM e GROUP BY a), m2 AS MATERIALIZED (SELECT e.a, min(m1.m) AS m FROM e JOIN m1 ON m1.a = e.b GROUP BY e.a), m3 AS MATERIALIZED (SELECT e.a, min(m2.m) AS m FROM e JOIN m2 ON m2.a = e.b GROUP BY e.a),
m4 AS MATERIALIZED (SELECT e.a, min(m3.m) AS m FROM e JOIN m3 ON m3.a = e.b GROUP BY e.a)
SELECT a AS part, m AS first FROM m4"""


@query(ROTATION)
def distinct_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations of the parts, some turned a little further in two steps and of either sign: the first of each that tolerance joins."""
    k = F.col("p_partkey")
    angle = F.radians((k * 13) % 40 * 9) + F.floor(k / 120) % 3 * F.lit(0.0016)
    axis = [((k * 7) % 5 - 2).cast("double"), ((k * 11) % 5 - 2).cast("double"), (1 + k % 3).cast("double")]
    sign = F.when(k % 2 == 0, 1.0).otherwise(-1.0)
    rows = table(spark, sf_dir, "part").select(k.alias("part"), F.array(*axis).alias("axis"), angle.alias("angle"), sign.alias("sign")).withColumn("n", rotations.norm(F.col("axis")))
    q = F.array(F.col("sign") * F.cos(F.col("angle") / 2), *[F.col("sign") * F.sin(F.col("angle") / 2) * F.col("axis")[i] / F.col("n") for i in range(3)])
    return rotation_sets.distinct_rotations(rows.select("part", q.alias("q")), "part", "q", tolerance=1e-3)
