"""Temporal and paired joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.geodesy import haversine
from driftline.functions.scalars import half_even as r
from driftline.operators import temporal
from driftline.sources.tables import HOUR_US, channel, events, masks

from . import query


@query("""
SELECT c.event_id, c.user_id, c.t_us, v.event_id AS r_event_id, v.t_us AS r_t_us, v.value AS r_value
FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v
ON c.user_id = v.user_id AND c.t_us >= v.t_us""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each click of a user."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value")
    click = channel(ev, "click").select("event_id", "user_id", "t_us")
    view = channel(ev, "view").select("user_id", "event_id", "t_us", "value")
    return temporal.asof_join(click, view, ["user_id"], "t_us")


@query("""
SELECT c.event_id, c.user_id, v.event_id AS r_event_id, v.t_us AS r_t_us
FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v
ON c.user_id = v.user_id AND c.t_us <= v.t_us""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    click, view = channel(ev, "click").drop("event_type"), channel(ev, "view").drop("event_type")
    return temporal.asof_join(click, view, ["user_id"], "t_us", forward=True).drop("t_us")


@query("""
, c AS (SELECT * FROM ev WHERE event_type = 'click'), v AS (SELECT user_id, t_us, value FROM ev WHERE event_type = 'view'),
f AS (SELECT user_id, min(t_us) AS t0, min_by(value, t_us) AS v0 FROM v GROUP BY user_id)
SELECT c.event_id, c.user_id, coalesce(v.value, f.v0) AS held
FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t_us >= v.t_us JOIN f ON f.user_id = c.user_id""")
def asof_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value at or before a time, the first one for earlier times; users without a view are left out."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value")
    click = channel(ev, "click").select("event_id", "user_id", "t_us")
    view = channel(ev, "view").select("user_id", "t_us", "value")
    first = view.groupBy("user_id").agg(F.min_by("value", "t_us").alias("v0"))
    out = temporal.asof_join(click, view, ["user_id"], "t_us").join(first, "user_id")
    return out.select("event_id", "user_id", F.coalesce("r_value", "v0").alias("held"))


INTERP = """
, c AS (SELECT event_id, user_id, t_us, value FROM ev WHERE event_type = 'click'),
v AS (SELECT user_id, t_us, avg(value) AS value, avg(lat) AS lat, avg(lon) AS lon FROM ev WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT c.*, v.t_us AS t0, v.value AS v0, v.lat AS lat0 FROM c ASOF JOIN v ON c.user_id = v.user_id AND c.t_us >= v.t_us),
i AS (SELECT b.*, v.t_us AS t1, v.value AS v1, v.lat AS lat1 FROM b ASOF JOIN v ON b.user_id = v.user_id AND b.t_us <= v.t_us)
"""


@query(INTERP + """
SELECT event_id, user_id,
  round_even(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((t_us - t0) / (t1 - t0)::DOUBLE) END, 6) AS i_value,
  round_even(CASE WHEN t1 = t0 THEN lat0 ELSE lat0 + (lat1 - lat0) * ((t_us - t0) / (t1 - t0)::DOUBLE) END, 6) AS i_lat
FROM i""")
def interp_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views interpolated at the clicks; clicks outside the views' span are left out."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value", "lat")
    click = channel(ev, "click").select("event_id", "user_id", "t_us")
    out = temporal.interp_join(click, channel(ev, "view"), ["user_id"], "t_us", ["value", "lat"])
    return out.filter("i_value IS NOT NULL").select("event_id", "user_id", r(F.col("i_value")).alias("i_value"), r(F.col("i_lat")).alias("i_lat"))


@query(INTERP + """
SELECT event_id, user_id, round_even(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((t_us - t0) / (t1 - t0)::DOUBLE) END, 6) AS i_value
FROM i WHERE t1 = t0 OR t1 - t0 <= 86400000000""")
def interp_join_max_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with nothing across gaps of over a day."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value")
    click = channel(ev, "click").select("event_id", "user_id", "t_us")
    out = temporal.interp_join(click, channel(ev, "view"), ["user_id"], "t_us", ["value"], max_gap=24 * HOUR_US)
    return out.filter("i_value IS NOT NULL").select("event_id", "user_id", r(F.col("i_value")).alias("i_value"))


@query(INTERP + """
, e AS (SELECT user_id, value - (v0 + CASE WHEN t1 = t0 THEN 0 ELSE (v1 - v0) * ((t_us - t0) / (t1 - t0)::DOUBLE) END) AS e, t_us FROM i
  WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'error' AND x.user_id = i.user_id AND i.t_us >= x.t_us AND i.t_us < x.t_us + 21600000000))
SELECT user_id, count(*) AS n, round_even(sqrt(avg(e * e)), 6) AS rmse, round_even(avg(abs(e)), 6) AS mae FROM e GROUP BY user_id""")
def interpolated_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of one channel against another, outside the masks."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value")
    click = channel(ev, "click").select("event_id", "user_id", "t_us", "value")
    clean = temporal.masked(click, masks(ev), ["user_id"], "t_us", "start_us", "end_us", width=6 * HOUR_US)
    out = temporal.interp_join(clean, channel(ev, "view"), ["user_id"], "t_us", ["value"]).filter("i_value IS NOT NULL")
    e = F.col("value") - F.col("i_value")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg(F.abs(e))).alias("mae"))


@query("""
, p AS (SELECT c.event_id, c.user_id, v.event_id AS r_event_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.t_us - c.t_us), v.t_us) AS k
  FROM ev c JOIN ev v ON c.user_id = v.user_id WHERE c.event_type = 'error' AND v.event_type = 'view')
SELECT event_id, user_id, r_event_id FROM p WHERE k = 1""")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view nearest in time to each error, the earlier one on a tie."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    out = temporal.nearest_join(channel(ev, "error").drop("event_type"), channel(ev, "view").drop("event_type"), ["user_id"], "t_us")
    return out.filter("r_event_id IS NOT NULL").select("event_id", "user_id", "r_event_id")


@query("""
, p AS (SELECT o.event_id, o.user_id, v.event_id AS r_event_id, row_number() OVER (PARTITION BY o.event_id ORDER BY abs(v.t_us - o.t_us - 18000000000), v.t_us) AS k
  FROM ev o JOIN ev v ON o.user_id = v.user_id AND abs(v.t_us - o.t_us - 18000000000) <= 86400000000 WHERE o.event_type = 'error' AND v.event_type = 'view')
SELECT event_id, user_id, r_event_id FROM p WHERE k = 1""")
def recovery_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample nearest to five hours after each outage's start, within a day of it."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    start = channel(ev, "error").select("event_id", "user_id", (F.col("t_us") + 5 * HOUR_US).alias("t_us"))
    out = temporal.nearest_join(start, channel(ev, "view").drop("event_type"), ["user_id"], "t_us", within=24 * HOUR_US)
    return out.filter("r_event_id IS NOT NULL").select("event_id", "user_id", "r_event_id")


@query("""
SELECT c.event_id, c.user_id, x.event_id AS mask_id, c.t_us - x.t_us AS since_us
FROM ev c JOIN ev x ON c.user_id = x.user_id AND c.t_us >= x.t_us AND c.t_us < x.t_us + 21600000000
WHERE c.event_type <> 'error' AND x.event_type = 'error'""")
def interval_stab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with every interval that holds them, by an equi-join on time bins."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    iv = channel(ev, "error").select("user_id", F.col("event_id").alias("id"), F.col("t_us").alias("start"), (F.col("t_us") + 6 * HOUR_US).alias("end"))
    out = temporal.range_join(ev.filter("event_type <> 'error'"), iv, ["user_id"], "t_us", "start", "end", width=6 * HOUR_US)
    return out.select("event_id", "user_id", F.col("iv_id").alias("mask_id"), (F.col("t_us") - F.col("iv_start")).alias("since_us"))


@query("""
, x AS (SELECT user_id, event_id, t_us + 600000000 AS s, t_us + 21600000000 - 600000000 AS e FROM ev WHERE event_type = 'error')
SELECT x.event_id AS segment, x.user_id, count(*) AS n, round_even(avg(c.value), 6) AS mean_value, round_even(avg(c.lat), 6) AS mean_lat
FROM x JOIN ev c ON c.user_id = x.user_id AND c.t_us >= x.s AND c.t_us < x.e GROUP BY ALL""")
def interval_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the samples inside each interval, shrunk by ten minutes at both ends."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value", "lat")
    edge = HOUR_US // 6
    iv = channel(ev, "error").select("user_id", F.col("event_id").alias("segment"), (F.col("t_us") + edge).alias("start"), (F.col("t_us") + 6 * HOUR_US - edge).alias("end"))
    out = temporal.range_join(ev, iv, ["user_id"], "t_us", "start", "end", width=6 * HOUR_US)
    return out.groupBy(F.col("iv_segment").alias("segment"), "user_id").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean_value"), r(F.avg("lat")).alias("mean_lat"))


@query("""
, d AS (SELECT user_id, t_us // 86400000000 AS day, event_type, avg(value) AS v FROM ev WHERE event_type IN ('purchase', 'signup') GROUP BY ALL)
SELECT a.user_id, a.day, round_even(a.v, 6) AS baseline, round_even(b.v, 6) AS candidate, round_even(b.v - a.v, 6) AS difference
FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = 'purchase' AND b.event_type = 'signup'""")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that both arms have scored, side by side."""
    d = daily_arms(events(spark, sf_dir))
    a = d.filter("event_type = 'purchase'").select("user_id", "day", F.col("v").alias("a"))
    b = d.filter("event_type = 'signup'").select("user_id", "day", F.col("v").alias("b"))
    return a.join(b, ["user_id", "day"]).select("user_id", "day", r(F.col("a")).alias("baseline"), r(F.col("b")).alias("candidate"), r(F.col("b") - F.col("a")).alias("difference"))


def daily_arms(ev: DataFrame) -> DataFrame:
    arms = ev.filter(F.col("event_type").isin("purchase", "signup"))
    return arms.groupBy("user_id", F.expr("t_us div 86400000000").alias("day"), "event_type").agg(F.avg("value").alias("v"))


@query("""
, d AS (SELECT user_id, t_us // 86400000000 AS day, event_type, avg(value) AS v FROM ev WHERE event_type IN ('purchase', 'signup') GROUP BY ALL),
p AS (SELECT a.v AS a, b.v AS b FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = 'purchase' AND b.event_type = 'signup')
SELECT count(*) AS n, round_even(quantile_cont(a, 0.5), 6) AS median_a, round_even(quantile_cont(b, 0.5), 6) AS median_b,
  round_even(avg(b - a), 6) AS mean_difference, round_even(quantile_cont(b - a, 0.5), 6) AS median_difference,
  round_even(avg((b < a)::INT), 6) AS share_better, round_even(avg((b < 10)::INT), 6) AS share_under_10 FROM p""")
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, differences and the share that got better."""
    p = paired_rows(spark, sf_dir).select(F.col("baseline").alias("a"), F.col("candidate").alias("b"))
    d = F.col("b") - F.col("a")
    half = lambda c: r(F.percentile(c, 0.5))
    return p.agg(
        F.count("*").alias("n"), half(F.col("a")).alias("median_a"), half(F.col("b")).alias("median_b"), r(F.avg(d)).alias("mean_difference"), half(d).alias("median_difference"),
        r(F.avg((d < 0).cast("int"))).alias("share_better"), r(F.avg((F.col("b") < 10).cast("int"))).alias("share_under_10"),
    )


@query("""
SELECT user_id, (t_us // 86400000000) AS day FROM ev WHERE event_type = 'purchase' INTERSECT SELECT user_id, (t_us // 86400000000) AS day FROM ev WHERE event_type = 'signup'""")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).select("user_id", "event_type", F.expr("t_us div 86400000000").alias("day"))
    return channel(d, "purchase").select("user_id", "day").intersect(channel(d, "signup").select("user_id", "day"))


@query("""
, n AS (SELECT user_id, t_us // 86400000000 AS day, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM ev GROUP BY ALL)
SELECT user_id, day, a AS n_view, b AS n_click, CASE WHEN a = 1 AND b = 1 THEN 'paired' WHEN a = 0 OR b = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status FROM n WHERE a + b > 0""")
def source_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each source in a group makes a pair; the rest stays on the list."""
    is_a, is_b = F.col("event_type") == "view", F.col("event_type") == "click"
    n = events(spark, sf_dir).groupBy("user_id", F.expr("t_us div 86400000000").alias("day")).agg(F.count_if(is_a).alias("n_view"), F.count_if(is_b).alias("n_click")).filter("n_view + n_click > 0")
    status = F.when((F.col("n_view") == 1) & (F.col("n_click") == 1), "paired").when((F.col("n_view") == 0) | (F.col("n_click") == 0), "unmatched").otherwise("ambiguous")
    return n.withColumn("status", status)


@query("""
, a AS (SELECT user_id, t_us // 86400000000 AS day, event_id FROM ev WHERE event_type = 'purchase'),
b AS (SELECT user_id, t_us // 86400000000 AS day, event_id FROM ev WHERE event_type = 'signup')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, a.event_id AS left_id, b.event_id AS right_id
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.day = b.day""")
def cross_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a key, and what has no partner."""
    d = events(spark, sf_dir).select("user_id", "event_type", "event_id", F.expr("t_us div 86400000000").alias("day"))
    a = channel(d, "purchase").select("user_id", "day", F.col("event_id").alias("left_id"))
    b = channel(d, "signup").select("user_id", "day", F.col("event_id").alias("right_id"))
    return a.join(b, ["user_id", "day"], "full_outer")


@query("""
SELECT a.event_id AS left_id, b.event_id AS right_id FROM ev a JOIN ev b ON a.t_us // 3600000000 = b.t_us // 3600000000 AND a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def exact_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two channels of one origin with the same time, to the hour."""
    ev = events(spark, sf_dir).select("user_id", "event_type", "event_id", F.expr("t_us div 3600000000").alias("hour"))
    return channel(ev, "view").withColumnRenamed("event_id", "left_id").drop("event_type").join(channel(ev, "click").withColumnRenamed("event_id", "right_id").drop("event_type"), ["user_id", "hour"]).select("left_id", "right_id")


@query("""
, a AS (SELECT user_id, t_us, value, event_id FROM ev WHERE event_type = 'view'), b AS (SELECT user_id, t_us, value, event_id FROM ev WHERE event_type = 'click')
SELECT user_id, t_us, 0::INT AS kind, event_id FROM a UNION ALL SELECT user_id, t_us, 1::INT AS kind, event_id FROM b""")
def time_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams as one, in the order of time and kind within a session."""
    ev = events(spark, sf_dir).select("user_id", "t_us", "event_id", "event_type")
    one = lambda kind, k: channel(ev, kind).select("user_id", "t_us", F.lit(k).alias("kind"), "event_id")
    return one("view", 0).unionByName(one("click", 1)).repartition("user_id").sortWithinPartitions("user_id", "t_us", "kind")


@query("""
, o AS (SELECT user_id, CASE WHEN count(*) > 65 THEN 'long' ELSE 'short' END AS label FROM ev GROUP BY user_id)
SELECT ev.event_type, coalesce(o.label, 'none') AS label, count(*) AS n FROM ev LEFT JOIN o USING (user_id) GROUP BY ALL""")
def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the sessions on every sample."""
    ev = events(spark, sf_dir).select("user_id", "event_type")
    label = ev.groupBy("user_id").agg(F.when(F.count("*") > 65, "long").otherwise("short").alias("label"))
    return ev.join(label, "user_id", "left").groupBy("event_type", F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


@query("""
, s AS (SELECT user_id, t_us + 3600000000 AS available_us, value FROM ev WHERE event_type = 'signup')
SELECT c.event_id, c.user_id, s.value AS calibration FROM (SELECT * FROM ev WHERE event_type = 'view') c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.t_us >= s.available_us""")
def calibration_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration that was available at each sample: an hour after it was made."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value")
    made = channel(ev, "signup").select("user_id", (F.col("t_us") + HOUR_US).alias("t_us"), "value")
    return temporal.asof_join(channel(ev, "view").select("event_id", "user_id", "t_us"), made, ["user_id"], "t_us").select("event_id", "user_id", F.col("r_value").alias("calibration"))


@query("""
, k AS (SELECT user_id, list_sort(list(DISTINCT md5(event_type || (floor(value * 10)::BIGINT % 50)::VARCHAR)))[1:64] AS f FROM ev GROUP BY user_id)
SELECT a.user_id AS a, b.user_id AS b, len(list_intersect(a.f, b.f))::BIGINT AS n_shared FROM k a JOIN k b ON a.user_id < b.user_id AND a.user_id // 10 = b.user_id // 10 WHERE len(list_intersect(a.f, b.f)) >= 8""")
def bottom_k_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of one recording that share at least 8 of their 64 smallest row hashes.

    Pairs come from shared hashes (an equi-join), so sessions without any in common never meet.
    """
    row = F.md5(F.concat("event_type", (F.floor(F.col("value") * 10) % 50).cast("string")).cast("binary"))
    hashes = events(spark, sf_dir).select("user_id", row.alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("h"))
    k = hashes.withColumn("k", rank).filter("k <= 64").select("user_id", "h", F.expr("user_id div 10").alias("recording"))
    b = k.select(F.col("user_id").alias("b"), "h", "recording")
    return k.withColumnRenamed("user_id", "a").join(b, ["recording", "h"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared")).filter("n_shared >= 8")


@query("""
, v AS (SELECT user_id, event_id, t_us, lat, lon FROM ev WHERE event_type = 'view'),
e AS (SELECT c.user_id, c.lat AS a, c.lon AS b, v.lat AS c, v.lon AS d FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF JOIN v ON c.user_id = v.user_id AND c.t_us >= v.t_us)
SELECT user_id, count(*) AS n, round_even(avg(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))), 3) AS mean_m FROM e GROUP BY user_id""")
def position_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distance of each click from the view before it."""
    ev = events(spark, sf_dir).select("user_id", "event_type", "t_us", "lat", "lon")
    out = temporal.asof_join(channel(ev, "click"), channel(ev, "view").drop("event_type"), ["user_id"], "t_us").filter("r_lat IS NOT NULL")
    d = haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), r(F.avg(d), 3).alias("mean_m"))
