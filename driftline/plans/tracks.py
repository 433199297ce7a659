"""Outage planning and scoring, spatial matching, geodesy, rotations and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import geodesy, rotations
from driftline.functions.scalars import half_even as r
from driftline.functions.scalars import undirected_residual, wrap180, yaw_of_heading
from driftline.operators import sequential, spatial, temporal
from driftline.sources.tables import HOUR_US, channel, events, table

from . import query

PLAN_SQL = """-- events
WITH RECURSIVE ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us,
  12.9::DOUBLE + ((user_id * 37 + event_id * 13) % 1000) / 10000::DOUBLE AS lat, 77.5::DOUBLE + ((user_id * 53 + event_id * 7) % 1000) / 10000::DOUBLE AS lon FROM events),
c AS (SELECT user_id, t_us FROM ev WHERE value >= 20),
p AS (SELECT user_id, min(t_us) AS s FROM c GROUP BY user_id
  UNION ALL SELECT p.user_id, (SELECT min(c.t_us) FROM c WHERE c.user_id = p.user_id AND c.t_us >= p.s + 43200000000 + 10800000000) FROM p WHERE p.s IS NOT NULL),
plan AS (SELECT user_id, s AS start_us, s + 43200000000 AS end_us FROM p WHERE s IS NOT NULL)
"""


def plan_of(ev: DataFrame) -> DataFrame:
    """Twelve-hour outages from samples of at least 20, three hours of recovery between."""
    return sequential.planned(ev.select("user_id", "t_us", "value"), ["user_id"], "t_us", F.col("value") >= 20, 12 * HOUR_US, 3 * HOUR_US)


@query(PLAN_SQL + "SELECT user_id, start_us, end_us FROM plan")
def outage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(events(spark, sf_dir)).select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


DIST = "sqrt(pow(radians({b}.lon - {a}.lon) * cos(radians({a}.lat)) * 6371000.0, 2) + pow(radians({b}.lat - {a}.lat) * 6371000.0, 2))"

SCORE_SQL = PLAN_SQL + f"""
, fixes AS (SELECT user_id, t_us, event_id, lat, lon FROM ev WHERE event_type = 'view'),
h AS (SELECT q.user_id, q.start_us, q.end_us, f.lat, f.lon FROM plan q ASOF LEFT JOIN fixes f ON f.user_id = q.user_id AND q.start_us >= f.t_us),
s AS (SELECT h.user_id, h.start_us, count(e.event_id) AS n, max({DIST.format(a='h', b='e')}) AS error_max_m, max_by({DIST.format(a='h', b='e')}, (e.t_us, e.event_id)) AS error_end_m, any_value(h.lat) AS held
  FROM h LEFT JOIN ev e ON e.user_id = h.user_id AND e.t_us >= h.start_us AND e.t_us < h.end_us GROUP BY ALL)
"""


def scored(ev: DataFrame) -> DataFrame:
    """Each outage with the errors of holding the last fix before it; outages without one or without truth keep their row."""
    plan = plan_of(ev)
    fixes = channel(ev, "view").select("user_id", F.col("t_us").alias("at"), "lat", "lon")
    held = temporal.asof_join(plan.withColumn("at", F.col("start")), fixes, ["user_id"], "at")
    truth = temporal.range_join(ev.select("user_id", "event_id", "t_us", "lat", "lon"), held, ["user_id"], "t_us", "start", "end", width=12 * HOUR_US)
    d = geodesy.planar(F.col("iv_r_lat"), F.col("iv_r_lon"), F.col("lat"), F.col("lon"))
    errors = truth.groupBy("user_id", F.col("iv_start").alias("start")).agg(F.count("*").alias("n"), F.max(d).alias("error_max_m"), F.max_by(d, F.struct("t_us", "event_id")).alias("error_end_m"))
    out = held.join(errors, ["user_id", "start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    outcome = F.when(F.col("r_lat").isNull(), "no_fix").when(F.col("n") < 2, "no_truth").otherwise("scored")
    return out.withColumn("outcome", outcome)


@query(SCORE_SQL + """
SELECT user_id, start_us, n, CASE WHEN held IS NULL THEN 'no_fix' WHEN n < 2 THEN 'no_truth' ELSE 'scored' END AS outcome, round_even(error_max_m, 3) AS error_max_m, round_even(error_end_m, 3) AS error_end_m FROM s""")
def outage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(events(spark, sf_dir)).select("user_id", F.col("start").alias("start_us"), "n", "outcome", r(F.col("error_max_m"), 3).alias("error_max_m"), r(F.col("error_end_m"), 3).alias("error_end_m"))


@query(SCORE_SQL + """
, o AS (SELECT *, CASE WHEN held IS NULL THEN 'no_fix' WHEN n < 2 THEN 'no_truth' ELSE 'scored' END AS outcome FROM s)
SELECT count(*) AS n, count(*) FILTER (outcome = 'scored') AS n_scored, count(*) FILTER (outcome = 'no_truth') AS n_no_truth, count(*) FILTER (outcome = 'no_fix') AS n_no_fix,
  round_even(quantile_cont(error_end_m, 0.5) FILTER (outcome = 'scored'), 3) AS median_m, round_even(quantile_cont(error_end_m, 0.9) FILTER (outcome = 'scored'), 3) AS p90_m,
  round_even(count(*) FILTER (outcome = 'scored' AND error_end_m < 5000) / count(*) FILTER (outcome = 'scored')::DOUBLE, 6) AS pass_rate, round_even(count(*) FILTER (outcome = 'scored' AND error_end_m < 5000) / count(*)::DOUBLE, 6) AS pass_rate_all FROM o""")
def outage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of what was scored; failures count in the second pass rate."""
    ok = F.col("outcome") == "scored"
    e = F.when(ok, F.col("error_end_m"))
    good = F.count_if(ok & (F.col("error_end_m") < 5000))
    return scored(events(spark, sf_dir)).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_scored"), F.count_if(F.col("outcome") == "no_truth").alias("n_no_truth"), F.count_if(F.col("outcome") == "no_fix").alias("n_no_fix"),
        r(F.percentile(e, 0.5), 3).alias("median_m"), r(F.percentile(e, 0.9), 3).alias("p90_m"), r(good / F.count_if(ok)).alias("pass_rate"), r(good / F.count("*")).alias("pass_rate_all"),
    )


@query("""
, p AS (SELECT event_id, user_id, t_us, value, bearing, (t_us - lag(t_us) OVER w) / 3.6e9 AS dt, lag(value) OVER w AS v0, lag(bearing) OVER w AS b0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))
SELECT user_id, round_even(sum(value * sin(radians(bearing)) * dt), 2) AS east, round_even(sum(value * cos(radians(bearing)) * dt), 2) AS north,
  round_even(sum((value - v0) * sin(radians(bearing)) * dt), 2) AS speed_part, round_even(sum(v0 * (sin(radians(bearing)) - sin(radians(b0))) * dt), 2) AS heading_part FROM p GROUP BY user_id""")
def drift_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement from speed and heading, and what of its change comes from speed and from heading."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    rows = events(spark, sf_dir).select("user_id", "value", "bearing", ((F.col("t_us") - F.lag("t_us").over(w)) / F.lit(3.6e9)).alias("dt"), F.lag("value").over(w).alias("v0"), F.lag("bearing").over(w).alias("b0"))
    s, c, s0 = F.sin(F.radians("bearing")), F.cos(F.radians("bearing")), F.sin(F.radians("b0"))
    v, v0, dt = F.col("value"), F.col("v0"), F.col("dt")
    return rows.groupBy("user_id").agg(r(F.sum(v * s * dt), 2).alias("east"), r(F.sum(v * c * dt), 2).alias("north"), r(F.sum((v - v0) * s * dt), 2).alias("speed_part"), r(F.sum(v0 * (s - s0) * dt), 2).alias("heading_part"))


@query("""
, k AS (SELECT event_id, (t_us - lag(t_us) OVER w) / 3.6e9 AS age, row_number() OVER w AS k, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS fixes, event_type FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))
SELECT event_id, CASE WHEN fixes = 0 THEN 'initialising' WHEN age > 24 THEN 'unaided' WHEN event_type = 'view' AND age > 12 THEN 'recovery' WHEN event_type = 'view' THEN 'gnss' ELSE 'fused' END AS mode FROM k""")
def localization_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    fixes = F.count_if(F.col("event_type") == "view").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events(spark, sf_dir).select("event_id", "event_type", ((F.col("t_us") - F.lag("t_us").over(w)) / F.lit(3.6e9)).alias("age"), fixes.alias("fixes"))
    view = F.col("event_type") == "view"
    mode = F.when(F.col("fixes") == 0, "initialising").when(F.col("age") > 24, "unaided").when(view & (F.col("age") > 12), "recovery").when(view, "gnss").otherwise("fused")
    return rows.select("event_id", mode.alias("mode"))


SEGMENTS = """
, seg AS (SELECT n_nationkey * 8 + k AS segment, 12.9::DOUBLE + ((n_nationkey * 41 + k * 17) % 100) / 1000::DOUBLE AS lat1, 77.5::DOUBLE + ((n_nationkey * 59 + k * 23) % 100) / 1000::DOUBLE AS lon1,
  12.9::DOUBLE + ((n_nationkey * 41 + k * 17) % 100 + k % 3 + 1) / 1000::DOUBLE AS lat2, 77.5::DOUBLE + ((n_nationkey * 59 + k * 23) % 100 + n_nationkey % 4) / 1000::DOUBLE AS lon2 FROM nation, (SELECT unnest(range(8)) AS k)),
pr AS (SELECT event_id, bearing, segment, radians(lon1 - lon) * cos(radians(lat)) * 6371000.0 AS x1, radians(lat1 - lat) * 6371000.0 AS y1, radians(lon2 - lon) * cos(radians(lat)) * 6371000.0 AS x2, radians(lat2 - lat) * 6371000.0 AS y2 FROM ev, seg WHERE event_type = 'view'),
pt AS (SELECT *, CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0 END AS t FROM pr),
pd AS (SELECT event_id, bearing, segment, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS d, t, atan2(x2 - x1, y2 - y1) AS heading FROM pt)
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point roads: each nation's row makes eight."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.explode(F.expr("sequence(0L, 7L)")).alias("k"))
    a, b = (F.col("n") * 41 + F.col("k") * 17) % 100, (F.col("n") * 59 + F.col("k") * 23) % 100
    th = F.lit(1000.0)
    return n.select(
        (F.col("n") * 8 + F.col("k")).alias("segment"), (F.lit(12.9) + a / th).alias("lat1"), (F.lit(77.5) + b / th).alias("lon1"),
        (F.lit(12.9) + (a + F.col("k") % 3 + 1) / th).alias("lat2"), (F.lit(77.5) + (b + F.col("n") % 4) / th).alias("lon2"),
    )


def near_segments(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    points = channel(events(spark, sf_dir), "view").select("event_id", "user_id", "t_us", "lat", "lon", "bearing", "value")
    return spatial.candidates(points, segments(spark, sf_dir), point="event_id", segment="segment", cell=0.01, radius_m=400.0, most=most)


@query(SEGMENTS + """
SELECT event_id, segment, round_even(d, 3) AS distance_m, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, segment) AS rank FROM pd WHERE d <= 400) WHERE rank <= 8""")
def top8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest roads within a radius of each fix."""
    return near_segments(spark, sf_dir, 8).select("event_id", "segment", r(F.col("distance_m"), 3).alias("distance_m"), F.col("rank").cast("long").alias("rank"))


@query(SEGMENTS + """
, n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, segment) AS rank FROM pd WHERE d <= 400),
a AS (SELECT *, radians(bearing) - heading + pi() AS w FROM n WHERE rank = 1),
m AS (SELECT *, abs(w - 2 * pi() * floor(w / (2 * pi())) - pi()) AS res FROM a)
SELECT event_id, segment, round_even(t, 5) AS place, round_even(least(res, pi() - res), 5) AS residual, round_even(-0.5 * (pow(d / 8.0, 2) + pow(least(res, pi() - res) / 0.35, 2)), 3) AS log_emission FROM m""")
def point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix on its nearest road: where, at what angle, and how likely."""
    near = near_segments(spark, sf_dir, 1)
    residual = undirected_residual(F.radians("bearing"), F.col("heading"))
    return near.select("event_id", "segment", r(F.col("place"), 5).alias("place"), r(residual, 5).alias("residual"), r(spatial.emission(F.col("distance_m"), residual), 3).alias("log_emission"))


@query(SEGMENTS + """
, n AS (SELECT * FROM pd WHERE d <= 400),
l AS (SELECT event_id, max(-0.5 * pow(d / 100.0, 2)) AS m FROM n GROUP BY event_id)
SELECT event_id, count(*) AS n, round_even(any_value(m) + ln(sum(exp(-0.5 * pow(d / 100.0, 2) - m))), 6) AS evidence FROM n JOIN l USING (event_id) GROUP BY event_id""")
def match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-sum-exp of all candidates' likelihoods."""
    near = near_segments(spark, sf_dir, 1 << 30).select("event_id", (-0.5 * F.pow(F.col("distance_m") / 100.0, 2)).alias("x"))
    near = near.withColumn("m", F.max("x").over(Window.partitionBy("event_id")))
    return near.groupBy("event_id").agg(F.count("*").alias("n"), r(F.first("m") + F.ln(F.sum(F.exp(F.col("x") - F.col("m"))))).alias("evidence"))


@query()
def hmm_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest road at each fix of a session, by a trellis over the ranked candidates."""
    near = near_segments(spark, sf_dir, 8)
    along = F.col("place") * geodesy.planar(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    emission = spatial.emission(F.col("distance_m") / 10, undirected_residual(F.radians("bearing"), F.col("heading")))
    # the row before a fix's first candidate is one of the fix before
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id", "rank")
    step = geodesy.planar(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    near = near.withColumn("step", F.when(F.col("rank") == 1, F.coalesce(step, F.lit(0.0))))
    rows = near.withColumn("travelled_m", F.max("step").over(Window.partitionBy("user_id", "event_id"))).select("user_id", "event_id", (F.col("t_us") / 1e6).alias("t"), "segment", F.xxhash64("lat1", "lon1").alias("u"), F.xxhash64("lat2", "lon2").alias("v"), emission.alias("log_emission"), "travelled_m", along.alias("along_m"))
    return sequential.viterbi(rows, "user_id", fix="event_id")


@query("""
, p AS (SELECT event_id, lat, lon, value AS alt, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
q AS (SELECT *, sin(radians(lon2 - lon)) * cos(radians(lat2)) AS y, cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)) AS x FROM p WHERE lat2 IS NOT NULL)
SELECT event_id, round_even(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))), 3) AS metres,
  round_even(degrees(atan2(y, x)) - 360 * floor(degrees(atan2(y, x)) / 360), 4) AS bearing,
  round_even(6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(lat)), 2)), 3) AS prime_vertical,
  round_even(9.7803253359 * (1 + 0.00193185265241 * pow(sin(radians(lat)), 2)) / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(lat)), 2)), 8) AS gravity FROM q""")
def geodesy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    p = events(spark, sf_dir).select("event_id", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).filter("lat2 IS NOT NULL")
    at = (F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return p.select("event_id", r(geodesy.haversine(*at), 3).alias("metres"), r(geodesy.bearing(*at), 4).alias("bearing"), r(geodesy.radii(F.col("lat"))[0], 3).alias("prime_vertical"), r(geodesy.normal_gravity(F.col("lat"), F.lit(0.0)), 8).alias("gravity"))


@query("""
, q AS (SELECT event_id, bearing + 180 AS w, 90 - bearing + 180 AS y, lat + degrees(value * cos(radians(bearing)) * 60 / 6371000.0) AS lat2, lon + degrees(value * sin(radians(bearing)) * 60 / (6371000.0 * cos(radians(lat)))) AS lon2 FROM ev)
SELECT event_id, w - 360 * floor(w / 360) - 180 AS wrapped, y - 360 * floor(y / 360) - 180 AS yaw, round_even(lat2, 8) AS lat2, round_even(lon2, 8) AS lon2 FROM q""")
def angles_and_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped angles, yaw of a heading, and where constant speed leads in a minute."""
    lat2, lon2 = geodesy.extrapolated(F.col("lat"), F.col("lon"), F.col("value"), F.col("bearing"), F.lit(60.0))
    return events(spark, sf_dir).select("event_id", wrap180(F.col("bearing")).alias("wrapped"), yaw_of_heading(F.col("bearing")).alias("yaw"), r(lat2, 8).alias("lat2"), r(lon2, 8).alias("lon2"))


@query()
def geodesy_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geodetic to ENU and ECEF and back: the errors are rounding alone."""
    lat, lon, alt = F.col("lat"), F.col("lon"), F.col("value")
    o = (F.lit(12.95), F.lit(77.55), F.lit(900.0))
    back = geodesy.geodetic(*geodesy.enu(lat, lon, alt, *o), *o)
    again = geodesy.geodetic_of_ecef(*geodesy.ecef(lat, lon, alt))
    worst = lambda p: F.greatest(F.abs(p[0] - lat), F.abs(p[1] - lon), F.abs(p[2] - alt) / 1e5)
    return events(spark, sf_dir).select("event_id", (worst(back) < 1e-9).alias("enu_ok"), (worst(again) < 1e-9).alias("ecef_ok"))


@query()
def rotation_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternions, matrices and angles agree with each other for every row's rotation vector."""
    v = F.array(F.radians("bearing") / 2, F.col("value") / 100, F.col("lat") - 12.9)
    x = F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    # one column for each step: expressions that refer to one twice would double each time
    rows = events(spark, sf_dir).select("event_id", v.alias("v"), x.alias("x"))
    rows = rows.withColumn("q", rotations.quat_of_vector(F.col("v"))).withColumn("arc", rotations.shortest_arc(F.col("x"), F.col("v")))
    rows = rows.withColumn("m", rotations.quat_matrix(F.col("q"))).withColumn("am", rotations.quat_matrix(F.col("arc")))
    rows = rows.withColumn("other", rotations.quat_of_matrix(F.col("m"))).withColumn("mx", rotations.mat_vec(F.col("m"), F.col("x"))).withColumn("turned", rotations.mat_vec(F.col("am"), F.col("x")))
    return rows.select(
        "event_id", rotations.is_rotation(F.col("m")).alias("is_rotation"), (rotations.quat_angle(F.col("q"), F.col("other")) < 1e-6).alias("same"),
        (F.abs(rotations.norm(F.col("mx")) - rotations.norm(F.col("x"))) < 1e-9).alias("length_kept"), F.coalesce(rotations.vector_angle(F.col("turned"), F.col("v")) < 1e-6, F.lit(True)).alias("arc_ends"),
    )


@query()
def strapdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attitude, velocity and position of each session from its rates and forces."""
    rows = events(spark, sf_dir).select("user_id", (F.col("t_us") / 3.6e9).alias("t"), *[F.lit(0.0).alias(c) for c in ("fx", "fy")], F.lit(9.80665).alias("fz"), *[F.lit(0.0).alias(c) for c in ("wx", "wy")], (F.radians("bearing") / 100).alias("wz"))
    return sequential.propagated(rows, "user_id")


@query()
def position_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gated filter over fixes, speeds and standstills."""
    ev = events(spark, sf_dir)
    east, north = geodesy.local_xy(F.col("lat"), F.col("lon"), F.lit(12.95), F.lit(77.55))
    kind = F.when(F.col("event_type") == "view", "fix").when(F.col("value") < 5, "stop").otherwise("speed")
    return sequential.filtered(ev.select("user_id", (F.col("t_us") / 1e6).alias("t"), kind.alias("kind"), east.alias("east"), north.alias("north"), (F.col("value") / 10).alias("speed"), F.radians("bearing").alias("heading")), "user_id")


@query()
def mount_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the direction of gravity leaves its reference."""
    ev = events(spark, sf_dir)
    return sequential.slips(ev.select("user_id", (F.col("t_us") / 3.6e9).alias("t"), (F.col("value") / 100).alias("gx"), (F.sin(F.radians("bearing"))).alias("gy"), F.lit(1.0).alias("gz")), "user_id", tau=24.0, dwell=2, cooldown=48.0)


@query("""
, s AS (SELECT user_id, count(*) AS n, sum(1.0::DOUBLE) AS a, sum(bearing / 100) AS b, sum(bearing / 100 * (bearing / 100)) AS c, sum(value) AS d, sum(bearing / 100 * value) AS e FROM ev GROUP BY user_id)
SELECT user_id, n, round_even((c * d - b * e) / (a * c - b * b), 5) AS b_one, round_even((a * e - b * d) / (a * c - b * b), 5) AS b_x FROM s""")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each session, by combined moments and a small solve."""
    rows = events(spark, sf_dir).select("user_id", F.lit(1.0).alias("one"), (F.col("bearing") / 100).alias("x"), F.col("value").alias("y"))
    return sequential.solved(rows, ["user_id"], ["one", "x"], "y").select("user_id", "n", r(F.col("b_one"), 5).alias("b_one"), r(F.col("b_x"), 5).alias("b_x"))


@query("""
, s AS (SELECT user_id, sum(sin(radians(bearing)) * cos(radians(value)) - cos(radians(bearing)) * sin(radians(value))) AS y, sum(cos(radians(bearing)) * cos(radians(value)) + sin(radians(bearing)) * sin(radians(value))) AS x FROM ev GROUP BY user_id)
SELECT user_id, round_even(degrees(atan2(y, x)), 5) AS yaw_deg FROM s""")
def horizontal_rotation_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation that turns one set of horizontal vectors best onto another: atan2 of cross and dot sums."""
    a, b = F.radians("bearing"), F.radians("value")
    y = F.sum(F.sin(a) * F.cos(b) - F.cos(a) * F.sin(b))
    x = F.sum(F.cos(a) * F.cos(b) + F.sin(a) * F.sin(b))
    return events(spark, sf_dir).groupBy("user_id").agg(r(F.degrees(F.atan2(y, x)), 5).alias("yaw_deg"))


@query("""
, a AS (SELECT user_id, min(t_us) AS t0 FROM ev WHERE event_type <> 'view' GROUP BY user_id),
f AS (SELECT * FROM ev WHERE event_type = 'view')
SELECT a.user_id, coalesce(max_by(f.event_id, f.t_us) FILTER (f.t_us <= t0), min_by(f.event_id, f.t_us) FILTER (f.t_us > t0)) AS anchor FROM a JOIN f USING (user_id) GROUP BY a.user_id""")
def anchor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fix at or before the first sample, else the first one after it."""
    ev = events(spark, sf_dir).select("user_id", "event_id", "event_type", "t_us")
    t0 = ev.filter("event_type <> 'view'").groupBy("user_id").agg(F.min("t_us").alias("t0"))
    f = channel(ev, "view").join(t0, "user_id")
    before, after = F.col("t_us") <= F.col("t0"), F.col("t_us") > F.col("t0")
    return f.groupBy("user_id").agg(F.coalesce(F.max_by(F.when(before, F.col("event_id")), F.when(before, F.col("t_us"))), F.min_by(F.when(after, F.col("event_id")), F.when(after, F.col("t_us")))).alias("anchor"))
