"""Mounting in three dimensions: samples of a device derived from the events, solved and released."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import half_even as r
from driftline.operators import in_motion, mounting
from driftline.sources.tables import events

from . import query
from .inertial import motion

WINDOWS = [240.0, 480.0, 720.0]
#: Hours stand for seconds: a session is a month long and has some seventy fixes.
LIMITS = mounting.Limits(stopped=0.6, least_stops=4, least_still=12, moving=1.5, least_moving=10, excitation=0.02, least_r=0.5, least_samples=40, least_fixes=5, half=2.0, longest_gap=48.0)


def drives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accelerometer, gyroscope and fixes of each session, t in hours from its beginning.

    A device that is turned and tilted by its user's number feels the change of speed ahead, speed times turn rate to the
    left and gravity, each with an offset from the row's number.
    """
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    t = (F.col("t_us") - F.min("t_us").over(Window.partitionBy("user_id"))) / F.lit(3.6e9)
    ev = events(spark, sf_dir).select("user_id", "event_id", t.alias("t"), (F.col("value") / 10).alias("speed"), "t_us")
    ev = ev.withColumn("along", F.coalesce((F.lead("speed").over(w) - F.lag("speed").over(w)) / F.nullif(F.lead("t").over(w) - F.lag("t").over(w), F.lit(0.0)), F.lit(0.0)))
    ev = ev.withColumn("turn", ((F.col("event_id") * 7) % 21 - 10) / F.lit(100.0)).withColumn("k", F.explode(F.expr("sequence(0L, 3L)")))
    psi, tau = (F.col("user_id") % 12) * (F.pi() / 6), (F.col("user_id") % 5) / F.lit(10.0)
    noise = lambda a: ((F.col("event_id") * a + F.col("k") * 17) % 11 - 5) / F.lit(100.0)
    left = F.col("speed") * F.col("turn")
    hx, hy = F.cos(psi) * F.col("along") - F.sin(psi) * left, F.sin(psi) * F.col("along") + F.cos(psi) * left
    at = (F.col("t") + (F.col("k") - 1.5) * 0.4).alias("t")
    up = F.lit(9.8) + noise(3)
    accel = ev.select("user_id", at, (hx * F.cos(tau) + up * F.sin(tau) + noise(13)).alias("x"), (hy + noise(19)).alias("y"), (up * F.cos(tau) - hx * F.sin(tau)).alias("z"))
    gyro = ev.select("user_id", at, (F.col("turn") * F.sin(tau) + 0.01).alias("x"), (noise(23) / 10 - 0.02).alias("y"), (F.col("turn") * F.cos(tau) + 0.03).alias("z"))
    return accel, gyro, ev.filter("k = 0").select("user_id", "t", "speed")


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mounting.solved(*drives(spark, sf_dir), "user_id", WINDOWS, LIMITS)


SOLUTION = """
, b AS (SELECT user_id, event_id, t_us, (t_us - min(t_us) OVER (PARTITION BY user_id)) / 3.6e9 AS t, value / 10 AS speed, ((event_id * 7) % 21 - 10) / 100.0::DOUBLE AS turn, (user_id % 12) * (pi() / 6) AS psi, (user_id % 5) / 10.0::DOUBLE AS tau FROM ev),
d AS (SELECT *, coalesce((lead(speed) OVER w - lag(speed) OVER w) / nullif(lead(t) OVER w - lag(t) OVER w, 0), 0) AS along FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
k AS (SELECT *, cos(psi) * along - sin(psi) * speed * turn AS hx, sin(psi) * along + cos(psi) * speed * turn AS hy, 9.8::DOUBLE + ((event_id * 3 + k * 17) % 11 - 5) / 100.0::DOUBLE AS g FROM d, (SELECT unnest(range(4)) AS k)),
acc AS MATERIALIZED (SELECT user_id, t + (k - 1.5::DOUBLE) * 0.4::DOUBLE AS t, hx * cos(tau) + g * sin(tau) + ((event_id * 13 + k * 17) % 11 - 5) / 100.0::DOUBLE AS x, hy + ((event_id * 19 + k * 17) % 11 - 5) / 100.0::DOUBLE AS y, g * cos(tau) - hx * sin(tau) AS z FROM k),
gyr AS MATERIALIZED (SELECT user_id, t + (k - 1.5::DOUBLE) * 0.4::DOUBLE AS t, turn * sin(tau) + 0.01::DOUBLE AS x, ((event_id * 23 + k * 17) % 11 - 5) / 100.0::DOUBLE / 10 - 0.02::DOUBLE AS y, turn * cos(tau) + 0.03::DOUBLE AS z FROM k),
win AS (SELECT unnest([240.0, 480.0, 720.0])::DOUBLE AS "window"),
f AS MATERIALIZED (SELECT user_id, "window", t, speed, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(speed) OVER w AS v0, lead(speed) OVER w AS v1 FROM b, win WHERE t <= "window" WINDOW w AS (PARTITION BY user_id, "window" ORDER BY t)),
nf AS (SELECT user_id, "window", count(*) AS n_fixes, count(*) FILTER (speed < 0.6) AS n_stops FROM f GROUP BY ALL),
sa AS (SELECT a.*, "window", EXISTS (SELECT 1 FROM f WHERE f.user_id = a.user_id AND f."window" = win."window" AND f.speed < 0.6 AND abs(f.t - a.t) <= 2) AS still FROM acc a, win WHERE a.t <= "window"),
sg AS (SELECT a.*, "window", EXISTS (SELECT 1 FROM f WHERE f.user_id = a.user_id AND f."window" = win."window" AND f.speed < 0.6 AND abs(f.t - a.t) <= 2) AS still FROM gyr a, win WHERE a.t <= "window"),
ua AS (SELECT user_id, "window", count(*) AS n, count(*) FILTER (still) AS ns, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(x) FILTER (still) AS sx, avg(y) FILTER (still) AS sy, avg(z) FILTER (still) AS sz FROM sa GROUP BY ALL),
ug AS (SELECT user_id, "window", count(*) AS n, avg(x) FILTER (still) AS sx, avg(y) FILTER (still) AS sy, avg(z) FILTER (still) AS sz FROM sg GROUP BY ALL),
p AS (SELECT nf.*, coalesce(ua.n, 0) AS na, coalesce(ug.n, 0) AS ng, n_stops >= 4 AND coalesce(ua.ns, 0) >= 12 AS rest, CASE WHEN rest THEN ua.sx ELSE ua.x END AS px, CASE WHEN rest THEN ua.sy ELSE ua.y END AS py, CASE WHEN rest THEN ua.sz ELSE ua.z END AS pz,
  CASE WHEN rest THEN coalesce(ug.sx, 0) ELSE 0 END AS bx, CASE WHEN rest THEN coalesce(ug.sy, 0) ELSE 0 END AS by_, CASE WHEN rest THEN coalesce(ug.sz, 0) ELSE 0 END AS bz FROM nf LEFT JOIN ua USING (user_id, "window") LEFT JOIN ug USING (user_id, "window")),
q AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS l, px / l AS ux, py / l AS uy, pz / l AS uz,
  -- helper x up, for a helper along x (or along y where up is near x)
  CASE WHEN abs(ux) < 0.9 THEN 0.0 ELSE uz END AS ex, CASE WHEN abs(ux) < 0.9 THEN -uz ELSE 0.0 END AS ey, CASE WHEN abs(ux) < 0.9 THEN uy ELSE -ux END AS ez, sqrt(ex * ex + ey * ey + ez * ez) AS m FROM p),
e AS (SELECT *, ex / m AS e1x, ey / m AS e1y, ez / m AS e1z, uy * e1z - uz * e1y AS e2x, uz * e1x - ux * e1z AS e2y, ux * e1y - uy * e1x AS e2z FROM q),
ma AS (SELECT f.user_id, f."window", f.t, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM f JOIN acc a ON a.user_id = f.user_id AND a.t >= f.t - 2 AND a.t < f.t + 2 AND a.t <= f."window" WHERE t0 IS NOT NULL AND t1 IS NOT NULL GROUP BY ALL),
mg AS (SELECT f.user_id, f."window", f.t, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM f JOIN gyr a ON a.user_id = f.user_id AND a.t >= f.t - 2 AND a.t < f.t + 2 AND a.t <= f."window" WHERE t0 IS NOT NULL AND t1 IS NOT NULL GROUP BY ALL),
h AS (SELECT f.user_id, f."window", (v1 - v0) / (t1 - t0) AS al, ma.x * e1x + ma.y * e1y + ma.z * e1z AS h1, ma.x * e2x + ma.y * e2y + ma.z * e2z AS h2, speed * ((mg.x - bx) * ux + (mg.y - by_) * uy + (mg.z - bz) * uz) AS la
  FROM f JOIN ma USING (user_id, "window", t) JOIN mg USING (user_id, "window", t) JOIN e USING (user_id, "window") WHERE speed >= 1.5 AND t1 - t0 > 0 AND t1 - t0 <= 48),
th AS (SELECT user_id, "window", count(*) AS moving, atan2(covar_pop(la, h1) - covar_pop(al, h2), covar_pop(al, h1) + covar_pop(la, h2)) AS theta, stddev_pop(al) AS excitation FROM h GROUP BY ALL),
co AS (SELECT user_id, "window", corr(cos(theta) * h1 - sin(theta) * h2, al) AS r_long, corr(sin(theta) * h1 + cos(theta) * h2, la) AS r_lat FROM h JOIN th USING (user_id, "window") GROUP BY ALL),
o AS (SELECT user_id, "window", CASE WHEN na < 40 OR ng < 40 OR n_fixes < 5 THEN 'data' WHEN coalesce(moving, 0) < 10 THEN 'moving' WHEN excitation < 0.02 THEN 'excitation' WHEN r_long >= 0.5 AND NOT isnan(r_long) THEN 'valid' ELSE 'r_long' END AS status, rest, ux, uy, uz, bx, by_, bz, theta,
  CASE WHEN NOT isnan(r_long) THEN r_long END AS r_long, CASE WHEN NOT isnan(r_lat) THEN r_lat END AS r_lat, coalesce(moving, 0) AS moving FROM e LEFT JOIN th USING (user_id, "window") LEFT JOIN co USING (user_id, "window"))
"""


@query(SOLUTION + """
SELECT user_id, "window", status, rest AS at_rest, round_even(ux, 6) AS up_x, round_even(uy, 6) AS up_y, round_even(uz, 6) AS up_z, round_even(degrees(bx), 6) AS bias_x, round_even(degrees(by_), 6) AS bias_y, round_even(degrees(bz), 6) AS bias_z,
  CASE WHEN moving > 2 THEN round_even(theta, 5) END AS theta, CASE WHEN moving > 2 THEN round_even(r_long, 5) END AS r_long, CASE WHEN moving > 2 THEN round_even(r_lat, 5) END AS r_lat, moving FROM o""")
def mount_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up, gyro bias in degrees, rotation about up and correlations for three windows of each session; angles of fewer than three rows are not shown."""
    some = lambda c: F.when(F.col("moving") > 2, r(F.col(c), 5)).alias(c)
    vectors = [r(F.degrees(F.col(v)[i]) if v == "bias" else F.col(v)[i]).alias(f"{v}_{a}") for v in ("up", "bias") for i, a in enumerate("xyz")]
    return solutions(spark, sf_dir).select("user_id", "window", "status", "at_rest", *vectors, some("theta"), some("r_long"), some("r_lat"), "moving")


@query(SOLUTION + """
, v AS (SELECT user_id, min("window") FILTER (status = 'valid') AS "window" FROM o GROUP BY user_id)
SELECT v.user_id, v."window", round_even(theta, 5) AS theta, moving, coalesce((SELECT string_agg(status, ',' ORDER BY x."window") FROM o x WHERE x.user_id = v.user_id AND x.status <> 'valid' AND (v."window" IS NULL OR x."window" < v."window")), '') AS refused FROM v LEFT JOIN o ON o.user_id = v.user_id AND o."window" = v."window" """)
def mount_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first window of each session that is valid, when it can be used, and why earlier ones were refused."""
    return mounting.released(solutions(spark, sf_dir), "user_id").select("user_id", "window", r(F.col("theta"), 5).alias("theta"), "moving", "refused")


#: Rows stand a second apart and speeds change slowly: what a segment must have is scaled to that.
IN_MOTION = in_motion.Limits(moving=3.5, parked=3.0, longest=20.0, most_accuracy=16.0, straight_rate=0.06, straight_share=0.6, excitation=0.05, slope=0.02, ratio_low=0.2, ratio_high=5.0, course_spread=60.0, baseline=10.0, course_displacement=60.0, agreement=50.0, handling_rate=0.02, remount_turn=4.0)


def moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fixes, samples and rests of each session, a second apart, felt by a device that is turned by its user's number and knocked now and then."""
    m = motion(spark, sf_dir).withColumn("t", F.col("k").cast("double"))
    psi = (F.col("user_id") % 8) * (F.pi() / 4)
    turn = F.col("turn") / 8
    along, left = F.col("along") / 10, F.col("speed") * turn
    noise = lambda a: ((F.col("event_id") * a) % 13 - 6) / F.lit(500.0)
    zero = F.lit(0.0)
    course = F.pmod(90.0 - F.degrees("yaw"), F.lit(360.0))
    fixes = m.select("user_id", "t", "speed", F.when(F.col("event_id") % 4 > 0, course).alias("course"), (F.col("east") * 10).alias("east"), (F.col("north") * 10).alias("north"), (F.lit(4.0) + F.col("event_id") % 13).alias("accuracy"))
    samples = m.select(
        "user_id", (F.col("t") + 0.5).alias("t"), (F.cos(psi) * along - F.sin(psi) * left + noise(7)).alias("fx"), (F.sin(psi) * along + F.cos(psi) * left + noise(5)).alias("fy"), F.lit(9.8).alias("fz"),
        zero.alias("wx"), zero.alias("wy"), (turn + noise(3)).alias("wz"),
    )
    tilt = F.when(F.col("k") > 45, 0.3).otherwise(0.0) * (F.col("user_id") % 3 == 0).cast("double") + noise(11)
    rests = m.filter("k % 15 = 1").select("user_id", "t", F.sin(tilt).alias("ux"), zero.alias("uy"), F.cos(tilt).alias("uz"))
    return fixes, samples, rests


@query()
def straight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of moving fixes with what its straight motion says of forward, or why it says nothing."""
    out = in_motion.segments(*moves(spark, sf_dir), "user_id", IN_MOTION)
    return out.select("user_id", "segment", "t", "code", r(F.col("yaw"), 5).alias("yaw"))


@query()
def in_motion_mount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each session's mount after every rest, accepted segment and turn."""
    fixes, samples, rests = moves(spark, sf_dir)
    found = in_motion.segments(fixes, samples, rests, "user_id", IN_MOTION)
    out = in_motion.estimated(rests, found, in_motion.handling(samples, fixes, "user_id", IN_MOTION), "user_id", IN_MOTION)
    return out.select("user_id", "t", "kind", "event", "status", r(F.col("yaw"), 5).alias("yaw"), "evidence")
