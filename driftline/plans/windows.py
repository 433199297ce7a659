"""Rolling frames, runs, gaps, integrals, lags and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.functions.geodesy import planar
from driftline.functions.scalars import half_even as r
from driftline.operators import windows
from driftline.sources.tables import HOUR_US, channel, events, table

from . import query



def session() -> WindowSpec:
    """A session's rows in the order of time."""
    return Window.partitionBy("user_id").orderBy("t_us", "event_id")


def so_far() -> WindowSpec:
    return session().rowsBetween(Window.unboundedPreceding, 0)


OVER = "OVER (PARTITION BY user_id ORDER BY t_us, event_id"


@query(f"""
, d AS (SELECT event_id, user_id, t_us, value - avg(value) {OVER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS d FROM ev)
SELECT event_id, user_id, round_even(d, 6) AS detrended, round_even(avg(d * d) {OVER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS power FROM d""")
def rolling_bandpower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal: the rolling mean of squares of the signal less its rolling mean."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "t_us", "value")
    detrended, power = windows.rolling_bandpower("value", session(), 10)
    return ev.withColumn("detrended", detrended).withColumn("power", power).select("event_id", "user_id", r(F.col("detrended")).alias("detrended"), r(F.col("power") + 1e-9).alias("power"))


@query(f"""
SELECT event_id, user_id, round_even(avg(value) {OVER} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS smooth,
  round_even(CASE WHEN count(*) {OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN avg(value) {OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS full5 FROM ev""")
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centred mean of even width, and a trailing one that is null until it is full."""
    ev = events(spark, sf_dir)
    return ev.select("event_id", "user_id", r(windows.centred_mean("value", session(), 6)).alias("smooth"), r(windows.full_mean("value", session(), 5)).alias("full5"))


@query(f"""
, s AS (SELECT event_id, user_id, t_us, CASE WHEN lag(t_us) {OVER}) IS NULL THEN 0 ELSE 0.5 * (value + lag(value) {OVER})) * ((t_us - lag(t_us) {OVER})) / 3.6e9) END AS area FROM ev)
SELECT event_id, user_id, round_even(sum(area) {OVER} ROWS UNBOUNDED PRECEDING), 4) AS integral FROM s""")
def cumulative_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running integral of the signal, in value hours."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "t_us", "value").withColumn("area", windows.trapezoid("value", "t_us", session(), float(HOUR_US)))
    return ev.select("event_id", "user_id", r(F.sum("area").over(so_far()), 4).alias("integral"))


@query(f"""
, n AS (SELECT event_id, user_id, value AS y1, lag(value) {OVER}) AS y0, lead(value) {OVER}) AS y2, (t_us - lag(t_us) {OVER})) / 3.6e9 AS a, (lead(t_us) {OVER}) - t_us) / 3.6e9 AS b FROM ev)
SELECT event_id, user_id, round_even(CASE WHEN y0 IS NOT NULL AND y2 IS NOT NULL THEN (a * a * y2 + (b * b - a * a) * y1 - b * b * y0) / (a * b * (a + b)) WHEN y2 IS NOT NULL THEN (y2 - y1) / b ELSE (y1 - y0) / a END, 3) AS slope FROM n""")
def numeric_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.select("event_id", "user_id", r(windows.gradient("value", "t_us", session(), float(HOUR_US)), 3).alias("slope"))


@query(f"""
, s AS (SELECT *, t_us - lag(t_us) {OVER}) AS step FROM ev),
d AS (SELECT event_id, user_id, sum(CASE WHEN step <= 0 OR step > 259200000000 THEN 1 ELSE 0 END) {OVER} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS bad,
  (lead(value, 2) {OVER}) - lag(value, 2) {OVER})) / ((lead(t_us, 2) {OVER}) - lag(t_us, 2) {OVER})) / 3.6e9) AS d FROM s)
SELECT event_id, user_id, round_even(d, 4) AS slope FROM d WHERE bad = 0 AND d IS NOT NULL""")
def span_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences over two rows each way, where no step between is over three days."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "t_us", "value").withColumn("step", F.col("t_us") - F.lag("t_us").over(session()))
    return ev.select("event_id", "user_id", r(windows.span_derivative("value", "t_us", session(), 2, 72 * HOUR_US, float(HOUR_US)), 4).alias("slope")).filter("slope IS NOT NULL")


@query(f"""
, s AS (SELECT event_id, user_id, t_us, bearing, coalesce(-360 * floor((bearing - lag(bearing) {OVER}) + 180) / 360), 0) AS jump FROM ev)
SELECT event_id, user_id, bearing + sum(jump) {OVER} ROWS UNBOUNDED PRECEDING) AS unwrapped FROM s""")
def heading_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "user_id", "t_us", "bearing").withColumn("jump", windows.unwrapped("bearing", session()).cast("double"))
    return ev.select("event_id", "user_id", (F.col("bearing") + F.sum("jump").over(so_far())).alias("unwrapped"))


@query(f"""
, s AS (SELECT event_id, user_id, t_us, value, bearing, coalesce(-360 * floor((bearing - lag(bearing) {OVER}) + 180) / 360), 0) AS jump FROM ev),
u AS (SELECT *, bearing + sum(jump) {OVER} ROWS UNBOUNDED PRECEDING) AS u FROM s),
m AS (SELECT *, avg(u) {OVER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM u),
g AS (SELECT event_id, user_id, value, (m - lag(m) {OVER})) / ((t_us - lag(t_us) {OVER})) / 3.6e9) AS rate FROM m)
SELECT event_id, user_id, round_even(CASE WHEN value < 3 THEN 0 ELSE rate END, 3) AS rate FROM g WHERE rate IS NOT NULL""")
def turn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrap, smooth over ten rows, differentiate, and zero it at low speed."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "t_us", "value", "bearing").withColumn("jump", windows.unwrapped("bearing", session()).cast("double"))
    u = ev.withColumn("u", F.col("bearing") + F.sum("jump").over(so_far())).withColumn("m", F.avg("u").over(session().rowsBetween(-9, 0)))
    rate = (F.col("m") - F.lag("m").over(session())) / ((F.col("t_us") - F.lag("t_us").over(session())) / F.lit(float(HOUR_US)))
    return u.withColumn("rate", rate).filter("rate IS NOT NULL").select("event_id", "user_id", r(F.when(F.col("value") < 3, 0.0).otherwise(F.col("rate")), 3).alias("rate"))


@query(f"""
, p AS (SELECT event_id, user_id, t_us, lat, lon, lag(lat) {OVER}) AS lat0, lag(lon) {OVER}) AS lon0 FROM ev),
s AS (SELECT *, coalesce(sqrt(pow(radians(lon - lon0) * cos(radians(lat0)) * 6371000.0, 2) + pow(radians(lat - lat0) * 6371000.0, 2)), 0) AS step FROM p)
SELECT event_id, user_id, round_even(sum(step) {OVER} ROWS UNBOUNDED PRECEDING), 2) AS travelled_m FROM s""")
def travelled_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "user_id", "t_us", "lat", "lon")
    step = F.coalesce(planar(F.lag("lat").over(session()), F.lag("lon").over(session()), F.col("lat"), F.col("lon")), F.lit(0.0))
    return ev.withColumn("step", step).select("event_id", "user_id", r(F.sum("step").over(so_far()), 2).alias("travelled_m"))


@query(f"""
, l AS (SELECT user_id, t_us, event_id, value, CASE WHEN value < 20 THEN 'stop' WHEN value > 80 THEN 'fast' ELSE 'moving' END AS label FROM ev),
c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id ORDER BY t_us) THEN 1 ELSE 0 END AS n FROM l),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT user_id, run, any_value(label) AS label, min(t_us) AS s, max(t_us) AS last, count(*) AS n, sum(value) AS total FROM i GROUP BY ALL),
e AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), last) AS e FROM g),
f AS (SELECT *, CASE WHEN e - s < 43200000000 THEN 'moving' ELSE label END AS label2 FROM e),
c2 AS (SELECT *, CASE WHEN label2 IS DISTINCT FROM lag(label2) OVER (PARTITION BY user_id ORDER BY s) THEN 1 ELSE 0 END AS k FROM f),
i2 AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run2 FROM c2)
SELECT user_id, any_value(label2) AS label, min(s) AS start_us, max(e) AS end_us, sum(n)::BIGINT AS n, round_even(sum(total) / sum(n), 6) AS mean_value FROM i2 GROUP BY user_id, run2""")
def speed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of stopped, moving and fast; those under half a day count as moving and merge."""
    label = F.when(F.col("value") < 20, "stop").when(F.col("value") > 80, "fast").otherwise("moving")
    rows = events(spark, sf_dir).select("user_id", "t_us", "value", label.alias("label"))
    out = windows.run_segments(rows, ["user_id"], "t_us", "label", shortest=12 * HOUR_US, other="moving")
    return out.select("user_id", "label", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n", r(F.col("total") / F.col("n")).alias("mean_value"))


@query("""
, l AS (SELECT user_id, t_us, event_id, value < 60 AS q FROM ev),
c AS (SELECT *, CASE WHEN q IS DISTINCT FROM lag(q) OVER (PARTITION BY user_id ORDER BY t_us) THEN 1 ELSE 0 END AS n FROM l),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT event_id, user_id, q AND count(*) OVER (PARTITION BY user_id, run) >= 4 AS in_run FROM i""")
def stationary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet samples that belong to a run of four at least."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "t_us", "value")
    return windows.long_runs(rows, ["user_id"], "t_us", F.col("value") < 60, 4).select("event_id", "user_id", "in_run")


@query(f"""
, g AS (SELECT user_id, event_id, lag(t_us) {OVER}) + 86400000000 AS start_us, t_us AS end_us FROM ev)
SELECT user_id, event_id, start_us, end_us FROM g WHERE end_us > start_us""")
def gap_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a day after a fix to the next one, where that comes later."""
    out = windows.gaps(events(spark, sf_dir).select("user_id", "event_id", "t_us"), ["user_id"], "t_us", F.lit(24 * HOUR_US))
    return out.select("user_id", "event_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"""
, g AS (SELECT user_id, lag(t_us) {OVER}) + 86400000000 AS s, t_us AS e FROM ev),
k AS (SELECT user_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS k FROM g WHERE e > s)
SELECT user_id, count(*) AS n, max(e - s) AS longest_us, sum(e - s)::BIGINT AS total_us FROM k WHERE k <= 5 GROUP BY user_id""")
def newest_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session's outages the five newest."""
    out = windows.gaps(events(spark, sf_dir).select("user_id", "event_id", "t_us"), ["user_id"], "t_us", F.lit(24 * HOUR_US))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("start")))
    d = F.col("end") - F.col("start")
    return out.withColumn("k", k).filter("k <= 5").groupBy("user_id").agg(F.count("*").alias("n"), F.max(d).alias("longest_us"), F.sum(d).alias("total_us"))


@query(f"""
, s AS (SELECT *, CASE WHEN lag(t_us) {OVER}) IS NULL OR t_us - lag(t_us) {OVER}) > 86400000000 OR lat > 12.99 IS DISTINCT FROM lag(lat > 12.99) {OVER}) THEN 1 ELSE 0 END AS n FROM ev),
r AS (SELECT *, sum(n) {OVER} ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM s)
SELECT user_id, part, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n FROM r WHERE lat <= 12.99 GROUP BY ALL""")
def trail_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks cut at gaps and where they leave the covered area."""
    ev = events(spark, sf_dir).select("user_id", "event_id", "t_us", "lat")
    out_of = F.col("lat") > 12.99
    gap = (F.col("t_us") - F.lag("t_us").over(session()) > 24 * HOUR_US) | ~out_of.eqNullSafe(F.lag(out_of).over(session()))
    cut = F.when(F.lag("t_us").over(session()).isNull() | gap, 1).otherwise(0)
    parts = ev.withColumn("cut", cut).withColumn("part", F.sum("cut").over(so_far()))
    return parts.filter(~out_of).groupBy("user_id", "part").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n"))


@query(f"""
, d AS (SELECT *, value - lag(value) {OVER}) AS d, row_number() {OVER}) AS rn FROM ev),
w AS (SELECT event_id, user_id, rn, avg(value) {OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean, stddev_pop(value) {OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS std,
  sqrt(avg(d * d) {OVER} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)) AS jerk, max(abs(d)) {OVER} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS shock FROM d)
SELECT event_id, user_id, round_even(mean, 6) AS mean, round_even(std, 5) AS std, round_even(jerk, 6) AS jerk_rms, round_even(shock, 6) AS shock FROM w WHERE rn >= 20 AND (rn - 20) % 5 = 0""")
def sliding_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of windows of twenty rows, every five rows."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "value", F.struct("t_us", "event_id").alias("at"))
    out = windows.sliding(rows, ["user_id"], "at", "value", size=20, stride=5)
    return out.select("event_id", "user_id", r(F.col("mean")).alias("mean"), r(F.col("std"), 5).alias("std"), r(F.col("jerk_rms")).alias("jerk_rms"), r(F.col("shock")).alias("shock"))


@query("""
, g AS (SELECT t_us // 3600000000 AS h, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM ev GROUP BY 1),
p AS (SELECT l.lag, x.a, y.b FROM (SELECT unnest(range(-6, 7)) AS lag) l, g x JOIN g y ON y.h = x.h + l.lag WHERE x.a IS NOT NULL AND y.b IS NOT NULL),
c AS (SELECT lag, count(*) AS n, corr(a, b) AS c FROM p GROUP BY lag)
SELECT lag, n, round_even(c, 6) AS corr, row_number() OVER (ORDER BY round_even(abs(c), 6) DESC, abs(lag), lag) AS rank FROM c""")
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two channels at each lag, on an hourly grid; the ranks are over the thirteen lags."""
    ev = events(spark, sf_dir).filter("event_type IN ('view', 'click')")
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    g = ev.groupBy(F.expr("t_us div 3600000000").alias("h")).agg(mean("view").alias("a"), mean("click").alias("b"))
    shifted = g.filter("a IS NOT NULL").select("a", "h", F.explode(F.expr("sequence(-6L, 6L)")).alias("lag")).withColumn("h", F.col("h") + F.col("lag"))
    c = shifted.join(g.filter("b IS NOT NULL").select("h", "b"), "h").groupBy("lag").agg(F.count("*").alias("n"), r(F.corr("a", "b")).alias("corr"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs("corr")), F.abs("lag"), "lag"))
    return c.withColumn("rank", rank.cast("long"))


@query(f"""
SELECT event_id, user_id, coalesce(max(t_us) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - t_us > 7200000000, false) AS late FROM ev""")
def reorder_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sample, in the order of arrival, is over two hours older than its channel's newest."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    return rows.select("event_id", "user_id", windows.lateness(rows, ["user_id", "event_type"], "event_id", "t_us", 2 * HOUR_US).alias("late"))


@query(f"""
, p AS (SELECT event_id, user_id, t_us, lat, lon, value, lag(t_us) {OVER}) AS t0, lag(lat) {OVER}) AS lat0, lag(lon) {OVER}) AS lon0, lag(value) {OVER}) AS v0 FROM ev)
SELECT event_id, user_id, round_even((t_us - t0) / 3.6e9, 6) AS dt_h, round_even(value - v0, 6) AS dv,
  round_even(sqrt(pow(radians(lon - lon0) * cos(radians(lat0)) * 6371000.0, 2) + pow(radians(lat - lat0) * 6371000.0, 2)), 3) AS moved_m
FROM p WHERE t_us - t0 > 0 AND t_us - t0 <= 54000000000""")
def fix_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, displacement and change since the fix before, if that is under fifteen hours old."""
    ev = events(spark, sf_dir)
    was = lambda c: F.lag(c).over(session())
    dt = F.col("t_us") - was("t_us")
    rows = ev.select("event_id", "user_id", dt.alias("dt"), (F.col("value") - was("value")).alias("dv"), planar(was("lat"), was("lon"), F.col("lat"), F.col("lon")).alias("m"))
    return rows.filter((F.col("dt") > 0) & (F.col("dt") <= 15 * HOUR_US)).select("event_id", "user_id", r(F.col("dt") / 3.6e9).alias("dt_h"), r(F.col("dv")).alias("dv"), r(F.col("m"), 3).alias("moved_m"))


@query("""
SELECT a.event_id, a.user_id, count(b.event_id) AS n, round_even(avg(b.value), 6) AS mean, round_even(stddev_pop(b.value), 5) AS std, round_even(min(b.value), 6) AS low
FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.t_us BETWEEN a.t_us - 172800000000 AND a.t_us WHERE a.event_type = 'view' GROUP BY ALL""")
def recent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features over the last two days before each view, itself included; no later row is read."""
    w = Window.partitionBy("user_id").orderBy("t_us").rangeBetween(-48 * HOUR_US, 0)
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value")
    out = rows.withColumn("n", F.count("*").over(w)).withColumn("mean", r(F.avg("value").over(w))).withColumn("std", r(F.stddev_pop("value").over(w), 5)).withColumn("low", r(F.min("value").over(w)))
    return channel(out, "view").select("event_id", "user_id", "n", "mean", "std", "low")


@query(f"""
, s AS (SELECT event_id, user_id, CASE WHEN value > 120 THEN 'poor' WHEN value > 40 THEN 'fair' ELSE 'good' END AS state, lag(CASE WHEN value > 120 THEN 'poor' WHEN value > 40 THEN 'fair' ELSE 'good' END) {OVER}) AS was FROM ev)
SELECT event_id, user_id, was, state FROM s WHERE was IS DISTINCT FROM state""")
def quality_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each change of state."""
    state = F.when(F.col("value") > 120, "poor").when(F.col("value") > 40, "fair").otherwise("good")
    rows = events(spark, sf_dir).select("event_id", "user_id", "t_us", state.alias("state")).withColumn("was", F.lag("state").over(session()))
    return rows.filter(~F.col("was").eqNullSafe(F.col("state"))).select("event_id", "user_id", "was", "state")


@query(f"""
, l AS (SELECT *, (value < 60) AS q, CASE WHEN (value < 60) IS DISTINCT FROM lag(value < 60) {OVER}) THEN 1 ELSE 0 END AS n FROM ev),
i AS (SELECT *, sum(n) {OVER} ROWS UNBOUNDED PRECEDING) AS run FROM l),
k AS (SELECT *, CASE WHEN q THEN (row_number() OVER (PARTITION BY user_id, run ORDER BY t_us, event_id) - 1) // 3 ELSE row_number() OVER (PARTITION BY user_id, run ORDER BY t_us, event_id) - 1 END AS part FROM i)
SELECT user_id, min(t_us) AS start_us, count(*) AS n, round_even(avg(value), 6) AS mean FROM k GROUP BY user_id, run, part""")
def adaptive_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of three samples while quiet, single samples otherwise."""
    rows = events(spark, sf_dir).select("user_id", "t_us", "event_id", "value", (F.col("value") < 60).alias("q"))
    runs = windows.islands(rows, ["user_id"], ["t_us", "event_id"], F.col("q"))
    k = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("t_us", "event_id")) - 1
    part = F.when(F.col("q"), F.floor(k / 3)).otherwise(k)
    return runs.withColumn("part", part).groupBy("user_id", "run", "part").agg(F.min("t_us").alias("start_us"), F.count("*").alias("n"), r(F.avg("value")).alias("mean")).drop("run", "part")


@query("""
, m AS (SELECT event_id, user_id, t_us, max(t_us) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ev)
SELECT event_id, user_id, t_us FROM m WHERE newest IS NULL OR t_us > newest""")
def keep_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.operators.temporal import strictly_increasing

    return strictly_increasing(events(spark, sf_dir).select("event_id", "user_id", "t_us"), ["user_id"], "event_id", "t_us")


@query(f"""
, l AS (SELECT event_id, user_id, floor(value / 50) AS v, event_type AS e, lag(floor(value / 50)) {OVER}) AS v0, lag(event_type) {OVER}) AS e0 FROM ev)
SELECT event_id, user_id FROM l WHERE e0 IS NULL OR v <> v0 OR e <> e0""")
def fix_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new fix where any of its values differs from the row before."""
    from driftline.operators.temporal import changed

    rows = events(spark, sf_dir).select("event_id", "user_id", F.struct("t_us", "event_id").alias("at"), F.floor(F.col("value") / 50).alias("v"), "event_type")
    return changed(rows, ["user_id"], "at", ["v", "event_type"]).select("event_id", "user_id")


@query("""-- orders
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def ranked_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each group, ties by name."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.cast("long").alias("rank")).filter("rank <= 3")


@query("""
, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT event_id, user_id FROM n WHERE (k - 1) % greatest(1, n // 20) = 0""")
def row_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th row of a session, so that about twenty are left: a sampling operator."""
    w = Window.partitionBy("user_id")
    rows = events(spark, sf_dir).select("event_id", "user_id").withColumn("k", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("n", F.count("*").over(w))
    return rows.filter(F.expr("k % greatest(1, n div 20) = 0")).select("event_id", "user_id")


@query("""
, o AS (SELECT user_id, event_id, max(t_us) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS newest, min(t_us) OVER (PARTITION BY user_id) AS origin FROM ev)
SELECT user_id, count(*) AS n FROM o WHERE newest <= origin + 864000000000 GROUP BY user_id""")
def prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came before the first sample ten days past the origin."""
    w = Window.partitionBy("user_id")
    rows = events(spark, sf_dir).select("user_id", "event_id", "t_us").withColumn("newest", F.max("t_us").over(w.orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))).withColumn("origin", F.min("t_us").over(w))
    return rows.filter(F.col("newest") <= F.col("origin") + 240 * HOUR_US).groupBy("user_id").agg(F.count("*").alias("n"))
