"""Reports over channels, fixes, trips and text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import geodesy
from driftline.functions.scalars import finite
from driftline.functions.scalars import half_even as r
from driftline.sources.tables import channel, events

from . import query
from .tracks import anchor_choice


@query("""
, p AS (SELECT event_type, value AS c, bearing / 3 AS r FROM ev WHERE isfinite(value)),
s AS (SELECT event_type, count(*) AS n, sqrt(avg(pow(c - r, 2))) AS e, stddev_pop(r) AS scale FROM p GROUP BY event_type)
SELECT event_type, n, round_even(e, 6) AS rmse, CASE WHEN scale >= 1e-12 THEN round_even(e / scale, 6) END AS normalised FROM s""")
def normalised_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square error of finite pairs, and as a share of the reference's deviation (null for a constant)."""
    p = events(spark, sf_dir).select("event_type", finite("value").alias("c"), (F.col("bearing") / 3).alias("r")).filter("c IS NOT NULL")
    s = p.groupBy("event_type").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("c") - F.col("r"), 2))).alias("e"), F.stddev_pop("r").alias("scale"))
    return s.select("event_type", "n", r(F.col("e")).alias("rmse"), F.when(F.col("scale") >= 1e-12, r(F.col("e") / F.col("scale"))).alias("normalised"))


@query("""
, g AS (SELECT event_type, sqrt(pow(value / 100, 2) + pow(sin(radians(bearing)), 2) + 1) AS size FROM ev),
t AS (SELECT event_type, size, degrees(acos(1 / size)) AS tilt FROM g)
SELECT event_type, count(*) AS n, round_even(min(tilt), 6) AS tilt_low, round_even(quantile_cont(tilt, 0.5), 6) AS tilt_p50, round_even(quantile_cont(tilt, 0.95), 6) AS tilt_p95, round_even(max(tilt), 6) AS tilt_high,
  round_even(avg(size), 6) AS size_mean, round_even(count(*) FILTER (tilt < 20) / count(*)::DOUBLE, 6) AS share_level FROM t GROUP BY event_type""")
def sensor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and tilt from up of each channel's gravity vectors, and the share that is nearly level."""
    size = F.sqrt(F.pow(F.col("value") / 100, 2) + F.pow(F.sin(F.radians("bearing")), 2) + 1)
    t = events(spark, sf_dir).select("event_type", size.alias("size")).withColumn("tilt", F.degrees(F.acos(1 / F.col("size"))))
    return t.groupBy("event_type").agg(
        F.count("*").alias("n"), r(F.min("tilt")).alias("tilt_low"), r(F.percentile("tilt", 0.5)).alias("tilt_p50"), r(F.percentile("tilt", 0.95)).alias("tilt_p95"), r(F.max("tilt")).alias("tilt_high"),
        r(F.avg("size")).alias("size_mean"), r(F.count_if(F.col("tilt") < 20) / F.count("*")).alias("share_level"),
    )


@query("""
, a AS (SELECT user_id, min(t_us) AS t0 FROM ev WHERE event_type <> 'view' GROUP BY user_id),
f AS (SELECT * FROM ev WHERE event_type = 'view'),
c AS (SELECT a.user_id, coalesce(max_by(f.event_id, f.t_us) FILTER (f.t_us <= t0), min_by(f.event_id, f.t_us) FILTER (f.t_us > t0)) AS anchor FROM a JOIN f USING (user_id) GROUP BY a.user_id),
o AS (SELECT user_id, t_us, lat, lon FROM ev JOIN c USING (user_id) WHERE event_id = anchor),
d AS (SELECT f.user_id, f.t_us - o.t_us AS dt, f.value, sqrt(pow(radians(f.lon - o.lon) * cos(radians(o.lat)) * 6371000.0, 2) + pow(radians(f.lat - o.lat) * 6371000.0, 2)) AS d FROM f JOIN o USING (user_id))
SELECT user_id, count(*) AS n, min(dt) / 1e6 AS first_s, max(dt) / 1e6 AS last_s, round_even(max(d), 3) AS far_max, round_even(quantile_cont(d, 0.95), 3) AS far_p95, round_even(avg(d), 3) AS far_mean,
  min(value) AS altitude_low, max(value) AS altitude_high FROM d GROUP BY user_id""")
def fix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: when its fixes come and how far they lie from its anchor."""
    f = channel(events(spark, sf_dir), "view").select("user_id", "event_id", "t_us", "lat", "lon", "value")
    # equi-joins on the session, one anchor in each
    o = f.join(anchor_choice(spark, sf_dir), "user_id").filter("event_id = anchor").select("user_id", F.col("t_us").alias("t0"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    east, north = geodesy.local_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    d = f.join(o, "user_id").select("user_id", "value", (F.col("t_us") - F.col("t0")).alias("dt"), F.sqrt(F.pow(east, 2) + F.pow(north, 2)).alias("d"))
    return d.groupBy("user_id").agg(
        F.count("*").alias("n"), (F.min("dt") / F.lit(1e6)).alias("first_s"), (F.max("dt") / F.lit(1e6)).alias("last_s"), r(F.max("d"), 3).alias("far_max"), r(F.percentile("d", 0.95), 3).alias("far_p95"), r(F.avg("d"), 3).alias("far_mean"),
        F.min("value").alias("altitude_low"), F.max("value").alias("altitude_high"),
    )


TRIP_PARTS = ("p50", "p68", "p95")


def spread(x: str) -> list[Column]:
    """10th, 50th and 90th percentile over trips."""
    return [r(F.percentile(x, q), 3).alias(f"{x}_over_{n}") for q, n in ((0.1, "low"), (0.5, "mid"), (0.9, "high"))]


@query("""
, e AS (SELECT user_id, sqrt(pow(radians(lon - 77.55) * cos(radians(12.95)) * 6371000.0, 2) + pow(radians(lat - 12.95) * 6371000.0, 2)) AS e FROM ev),
t AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'held_out' ELSE 'development' END AS part, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.68) AS p68, quantile_cont(e, 0.95) AS p95 FROM e GROUP BY user_id)
SELECT part, count(*) AS trips, """ + ", ".join(f"round_even(quantile_cont({x}, {q}), 3) AS {x}_over_{n}" for x in TRIP_PARTS for q, n in ((0.1, "low"), (0.5, "mid"), (0.9, "high"))) + " FROM t GROUP BY part")
def trip_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each trip's error percentiles spread over the trips of a split; development's ``p68_over_mid`` is the declared accuracy."""
    east, north = geodesy.local_xy(F.col("lat"), F.col("lon"), F.lit(12.95), F.lit(77.55))
    e = events(spark, sf_dir).select("user_id", F.sqrt(F.pow(east, 2) + F.pow(north, 2)).alias("e"))
    t = e.groupBy("user_id").agg(*[F.percentile("e", q).alias(x) for x, q in zip(TRIP_PARTS, (0.5, 0.68, 0.95), strict=True)])
    part = F.when(F.col("user_id") % 5 == 0, "held_out").otherwise("development")
    return t.groupBy(part.alias("part")).agg(F.count("*").alias("trips"), *[c for x in TRIP_PARTS for c in spread(x)])


@query("""
, p AS (SELECT event_type, props, count(*) AS n, sum(count(*)) OVER (PARTITION BY event_type) AS total FROM ev GROUP BY event_type, props),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, props NULLS LAST) AS place FROM p)
SELECT event_type, place, props, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS parsed, n, round_even(n / total::DOUBLE, 6) AS share FROM k WHERE place <= 30""")
def text_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty most frequent texts of a field by channel, nulls counted too, with the number they hold.

    Rows are counted before they are ranked, so a window sees each distinct text once.
    """
    p = events(spark, sf_dir).groupBy("event_type", "props").agg(F.count("*").alias("n"))
    total = p.groupBy("event_type").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), F.col("props").asc_nulls_last()))
    top = p.withColumn("place", place.cast("long")).filter("place <= 30").join(F.broadcast(total), "event_type")
    return top.select("event_type", "place", "props", F.get_json_object("props", "$.k").try_cast("long").alias("parsed"), "n", r(F.col("n") / F.col("total")).alias("share"))
