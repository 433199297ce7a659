"""Alignment, calibration, pairing, samples and trackers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import half_even as r
from driftline.operators import calibration, temporal, windows
from driftline.sources.tables import HOUR_US, channel, events, table

from . import query

OVER = "OVER (PARTITION BY user_id ORDER BY t_us"


@query(f"""
, v AS (SELECT user_id, t_us, value FROM ev WHERE event_type = 'view'),
s AS (SELECT user_id, t_us, value, sum(coalesce(0.5 * (value + p) * (t_us - pt) / 3.6e9, 0)) {OVER} ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, lag(value) {OVER}) AS p, lag(t_us) {OVER}) AS pt FROM v)),
x AS (SELECT user_id, event_id, t_us AS s, t_us + 86400000000 AS e FROM ev WHERE event_type = 'error'),
a0 AS (SELECT x.*, s.t_us AS t0, s.cum AS c0 FROM x ASOF JOIN s ON x.user_id = s.user_id AND x.s >= s.t_us),
a AS (SELECT a0.*, CASE WHEN t0 = a0.s THEN c0 ELSE c0 + (s.cum - c0) * ((a0.s - t0) / (s.t_us - t0)::DOUBLE) END AS ca FROM a0 ASOF JOIN s ON a0.user_id = s.user_id AND a0.s <= s.t_us),
b0 AS (SELECT a.user_id, a.event_id, a.s, a.e, a.ca, s.t_us AS t0, s.cum AS c0 FROM a ASOF JOIN s ON a.user_id = s.user_id AND a.e >= s.t_us),
b AS (SELECT b0.*, CASE WHEN t0 = b0.e THEN c0 ELSE c0 + (s.cum - c0) * ((b0.e - t0) / (s.t_us - t0)::DOUBLE) END AS cb FROM b0 ASOF JOIN s ON b0.user_id = s.user_id AND b0.e <= s.t_us)
SELECT user_id, event_id, round_even((cb - ca) / 24, 5) AS mean FROM b""")
def interval_integral_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a signal over a day from each error on, out of its running integral."""
    ev = events(spark, sf_dir).select("user_id", "event_id", "event_type", "t_us", "value")
    iv = channel(ev, "error").select("user_id", "event_id", F.col("t_us").alias("start"), (F.col("t_us") + 24 * HOUR_US).alias("end"))
    out = calibration.integral_means(channel(ev, "view").select("user_id", "t_us", "value"), iv, ["user_id"], "t_us", "value", "start", "end", float(HOUR_US))
    return out.filter("mean IS NOT NULL").select("user_id", "event_id", r(F.col("mean"), 5).alias("mean"))


@query("""
, o AS (SELECT unnest([-14400000000, -7200000000, 0, 7200000000, 14400000000]) AS "offset"),
v AS (SELECT user_id, t_us, avg(value) AS value FROM ev WHERE event_type = 'view' GROUP BY ALL),
c AS (SELECT user_id, t_us + "offset" AS t_us, value, "offset" FROM ev, o WHERE event_type = 'click'),
b AS (SELECT c.*, v.t_us AS t0, v.value AS v0 FROM c ASOF JOIN v ON c.user_id = v.user_id AND c.t_us >= v.t_us),
i AS (SELECT b.*, v.t_us AS t1, v.value AS v1 FROM b ASOF JOIN v ON b.user_id = v.user_id AND b.t_us <= v.t_us),
d AS (SELECT "offset", abs(value - CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((t_us - t0) / (t1 - t0)::DOUBLE) END) AS d FROM i)
SELECT "offset", count(*) AS n, round_even(avg(d), 6) AS mean, round_even(quantile_cont(d, 0.5), 6) AS median FROM d GROUP BY "offset" """)
def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well one channel follows another at each of five clock offsets."""
    ev = events(spark, sf_dir).select("user_id", "event_type", "t_us", "value")
    click, view = channel(ev, "click").select("user_id", "t_us", "value"), channel(ev, "view").select("user_id", "t_us", F.col("value").alias("y"))
    out = calibration.offset_scan(click, view, ["user_id"], "t_us", "value", "y", [k * HOUR_US for k in (-4, -2, 0, 2, 4)])
    return out.select("offset", "n", r(F.col("mean")).alias("mean"), r(F.col("median")).alias("median"))


@query("""
, e AS (SELECT user_id, min(event_id) AS a0, max(event_id) AS a1, min(t_us) AS b0, max(t_us) AS b1 FROM ev GROUP BY user_id HAVING max(event_id) > min(event_id))
SELECT user_id, round_even((b1 - b0) / (a1 - a0)::DOUBLE, 2) AS scale FROM e""")
def affine_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of one clock against another, from the ends of both."""
    out = calibration.affine_clock(events(spark, sf_dir).select("user_id", "event_id", "t_us"), ["user_id"], "event_id", "t_us")
    return out.select("user_id", r(F.col("scale"), 2).alias("scale")).filter("scale IS NOT NULL")


@query("""
, p AS (SELECT user_id, event_id, t_us, value, least(2, floor((t_us - min(t_us) OVER (PARTITION BY user_id)) * 3 / greatest(max(t_us) OVER (PARTITION BY user_id) - min(t_us) OVER (PARTITION BY user_id), 1)::DOUBLE))::BIGINT AS part FROM ev)
SELECT user_id, part, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY value DESC, t_us) AS k FROM p) WHERE k = 1""")
def window_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest sample in each third of a session."""
    return calibration.best_windows(events(spark, sf_dir).select("user_id", "event_id", "t_us", "value"), ["user_id"], "t_us", "value").select("user_id", "part", "event_id")


@query()
def sensor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of a session paired as they come, at most six hours apart."""
    rows = events(spark, sf_dir).filter("event_type IN ('view', 'click')").select("user_id", F.col("t_us").alias("t"), F.when(F.col("event_type") == "view", "a").otherwise("b").alias("sensor"), F.col("event_id").alias("id"))
    return calibration.greedy_pairs(rows, "user_id", most=6 * HOUR_US)


@query("""
, q AS (SELECT user_id, cos(radians(bearing)) AS x, sin(radians(bearing)) AS y, cos(radians(value)) AS f, sin(radians(value)) AS s FROM ev),
m AS (SELECT user_id, count(*) AS n, sum(x * s - y * f) AS c, sum(x * f + y * s) AS d, sum(x * x + y * y) AS p, sum(f * f + s * s) AS q FROM q GROUP BY user_id)
SELECT user_id, n, CASE WHEN n >= 60 THEN round_even(atan2(c, d), 6) END AS yaw, CASE WHEN n >= 60 THEN round_even(sqrt(d * d + c * c) / sqrt(p * q), 6) END AS quality FROM m""")
def mount_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mounting angle of each session with sixty samples at least, and how well it fits."""
    a, b = F.radians("bearing"), F.radians("value")
    rows = events(spark, sf_dir).select("user_id", F.cos(a).alias("x"), F.sin(a).alias("y"), F.cos(b).alias("f"), F.sin(b).alias("s"))
    out = calibration.mount_yaw(rows, ["user_id"], "x", "y", "f", "s", least=60)
    return out.select("user_id", "n", r(F.col("yaw")).alias("yaw"), r(F.col("quality")).alias("quality"))


@query("""
, w AS (SELECT unnest([120, 240, 480])::BIGINT AS hours),
o AS (SELECT user_id, min(t_us) AS t0 FROM ev GROUP BY user_id),
c AS (SELECT ev.user_id, hours, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM ev JOIN o USING (user_id), w WHERE t_us < t0 + hours * 3600000000 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hours) AS k FROM c WHERE n >= 15 AND std < 60)
SELECT o.user_id, hours, n, round_even(mean, 6) AS mean FROM o LEFT JOIN k ON k.user_id = o.user_id AND k.k = 1""")
def first_valid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of three growing windows with enough rows and a small spread."""
    ev = events(spark, sf_dir).select("user_id", "t_us", "value").withColumn("t0", F.min("t_us").over(Window.partitionBy("user_id")))
    rows = ev.withColumn("hours", F.explode(F.array(*[F.lit(h).cast("long") for h in (120, 240, 480)]))).filter(F.col("t_us") < F.col("t0") + F.col("hours") * HOUR_US)
    c = rows.groupBy("user_id", "hours").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    out = calibration.first_valid(c, ["user_id"], "hours", (F.col("n") >= 15) & (F.col("std") < 60))
    return out.select("user_id", "hours", "n", r(F.col("mean")).alias("mean"))


@query("""
, b0 AS (SELECT user_id, event_id, event_type, t_us, value, min(t_us) OVER (PARTITION BY user_id) AS begun FROM ev),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS k FROM b0 WHERE event_type = 'view'),
h AS (SELECT unnest([2, 5, 10, 15, 20, 30, 45, 60])::BIGINT AS horizon_h),
s AS (SELECT f.user_id, f.event_id, horizon_h, value, t_us + horizon_h * 3600000000 AS t FROM f, h WHERE (k - 1) % 4 = 0 AND value >= 3 AND t_us - begun >= 5 * 3600000000),
v AS (SELECT user_id, t_us, avg(value) AS value FROM ev WHERE event_type = 'view' GROUP BY ALL),
a AS (SELECT s.*, v.t_us AS t0, v.value AS v0 FROM s ASOF JOIN v ON s.user_id = v.user_id AND s.t >= v.t_us),
b AS (SELECT a.*, v.t_us AS t1, v.value AS v1 FROM a ASOF JOIN v ON a.user_id = v.user_id AND a.t <= v.t_us)
SELECT user_id, event_id, horizon_h, round_even(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)::DOUBLE) END - value, 6) AS residual FROM b""")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth fix at eight horizons, with the change until then.

    A fix is eligible from the fifth hour of its session on and at a value of 3 at least.
    """
    begun = F.min("t_us").over(Window.partitionBy("user_id"))
    ev = events(spark, sf_dir).select("user_id", "event_id", "event_type", "t_us", "value").withColumn("begun", begun).filter("event_type = 'view'")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id"))
    horizons = F.explode(F.array(*[F.lit(h).cast("long") for h in (2, 5, 10, 15, 20, 30, 45, 60)]))
    eligible = ev.withColumn("k", k).filter((F.col("k") % 4 == 1) & (F.col("value") >= 3) & (F.col("t_us") - F.col("begun") >= 5 * HOUR_US))
    s = eligible.select("user_id", "event_id", "t_us", "value", horizons.alias("horizon_h")).withColumn("t_us", F.col("t_us") + F.col("horizon_h") * HOUR_US)
    out = temporal.interp_join(s.withColumnRenamed("value", "v"), ev.select("user_id", "t_us", "value"), ["user_id"], "t_us", ["value"]).filter("i_value IS NOT NULL")
    return out.select("user_id", "event_id", "horizon_h", r(F.col("i_value") - F.col("v")).alias("residual"))


def folds(rows: DataFrame) -> DataFrame:
    """Sizes of the training parts with each drive held out in turn: totals less the drive's own, with no join of all pairs."""
    n = rows.filter("user_id IS NOT NULL").groupBy("user_id", (F.col("user_id") % 5).alias("grp")).agg(F.count("*").alias("n"))
    total = n.groupBy("grp").agg(F.sum("n").alias("all"))
    held = n.select(F.col("user_id").alias("fold"), F.col("grp").alias("own"), F.col("n").alias("minus"))
    # a literal list of what a remainder can be stands for the totals' keys
    each = held.withColumn("grp", F.explode(F.array(*[F.lit(g).cast("long") for g in range(-4, 5)]))).join(F.broadcast(total), "grp")
    return each.select("fold", "grp", (F.col("all") - F.when(F.col("own") == F.col("grp"), F.col("minus")).otherwise(0)).alias("n")).filter("n > 0")


@query()
def leave_one_out_every_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the training parts for every drive as the one held out."""
    return folds(events(spark, sf_dir).select("user_id"))


@query("""
SELECT a.user_id AS fold, b.user_id % 5 AS grp, count(*) AS n FROM (SELECT DISTINCT user_id FROM ev) a, ev b WHERE a.user_id <> b.user_id GROUP BY ALL""")
def leave_one_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every drive, held against SQL that joins all pairs; Spark takes totals less own."""
    return folds(events(spark, sf_dir).select("user_id"))


@query(f"""
, f AS (SELECT *, count(*) FILTER (event_type = 'view') {OVER}, event_id ROWS UNBOUNDED PRECEDING) AS fix FROM ev),
s AS (SELECT event_id, user_id, fix, t_us, (t_us - lag(t_us) OVER w) / 3.6e9 * 0.5 * (value + lag(value) OVER w) AS area FROM f WHERE fix > 0 WINDOW w AS (PARTITION BY user_id, fix ORDER BY t_us, event_id))
SELECT event_id, user_id, fix, round_even(sum(coalesce(area, 0)) OVER (PARTITION BY user_id, fix ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING), 4) AS integral FROM s""")
def anchored_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running integral since the last fix, begun anew at each one."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us", "value").withColumn("fix", F.count_if(F.col("event_type") == "view").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("fix > 0")
    own = Window.partitionBy("user_id", "fix").orderBy("t_us", "event_id")
    rows = rows.withColumn("area", windows.trapezoid("value", "t_us", own, float(HOUR_US)))
    return rows.select("event_id", "user_id", "fix", r(F.sum("area").over(own.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("integral"))


@query("""
, o AS (SELECT user_id, min(t_us) AS t0 FROM ev GROUP BY user_id),
s AS (SELECT ev.user_id, (t_us - t0) // 86400000000 AS slot, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM ev JOIN o USING (user_id) GROUP BY ALL),
q AS (SELECT *, s < 40 AS quiet, slot - row_number() OVER (PARTITION BY user_id, s < 40 ORDER BY slot) AS run FROM s)
SELECT user_id, min(slot) AS first_slot, count(*) AS n_slots, sum(n)::BIGINT AS n, round_even(sum(n * m) / sum(n), 6) AS mean FROM q WHERE quiet GROUP BY user_id, run""")
def stationary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet days, counted from a session's first sample, merged while they follow each other; moments merge exactly."""
    ev = events(spark, sf_dir).select("user_id", "t_us", "value").withColumn("t0", F.min("t_us").over(Window.partitionBy("user_id")))
    slots = ev.groupBy("user_id", F.expr("(t_us - t0) div 86400000000").alias("slot")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).filter("s < 40")
    run = F.col("slot") - F.row_number().over(Window.partitionBy("user_id").orderBy("slot"))
    return slots.withColumn("run", run).groupBy("user_id", "run").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"), F.sum("n").alias("n"), r(F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")).drop("run")


@query()
def doppler_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A velocity for each order from its lines, as if they were satellites in view."""
    u = lambda k: F.sin(F.col("l_linenumber") * k + F.col("l_partkey") % 13)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", u(1.0).alias("ux"), u(2.0).alias("uy"), u(3.0).alias("uz"), (F.col("l_quantity") / 10).alias("rate"), (1 + F.col("l_discount")).alias("weight"))
    return calibration.doppler_velocity(rows, ["l_orderkey"])


@query("""
SELECT user_id, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, count(*) FILTER (event_type = 'error') AS n_diagnostics, count(DISTINCT event_type) AS n_channels,
  round_even(count(*) * 3.6e9 / nullif(max(t_us) - min(t_us), 0), 8) AS per_hour FROM ev GROUP BY user_id""")
def recording_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, span and rate of each recording."""
    span = F.nullif(F.max("t_us") - F.min("t_us"), F.lit(0))
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count_if(F.col("event_type") == "error").alias("n_diagnostics"),
        F.countDistinct("event_type").alias("n_channels"), r(F.count("*") * 3.6e9 / span, 8).alias("per_hour"),
    )


@query("""
, m AS (SELECT DISTINCT user_id % 3 AS mask FROM ev UNION ALL SELECT NULL),
h AS (SELECT m.mask, ev.event_type, m.mask IS NOT NULL AND ev.event_type = 'view' AND (t_us // 21600000000) % 3 = m.mask AS hidden FROM m, ev)
SELECT mask, event_type, count(*) AS n_total, count(*) FILTER (hidden) AS n_withheld, count(*) FILTER (NOT hidden) AS n_yielded FROM h GROUP BY ALL""")
def mask_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three masks withholds, and the unmasked baseline: the masks are a literal list."""
    masks = F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 1, 2, None)]))
    rows = events(spark, sf_dir).select("event_type", F.expr("(t_us div 21600000000) % 3").alias("slot"), masks.alias("mask"))
    hidden = F.coalesce((F.col("event_type") == "view") & (F.col("slot") == F.col("mask")), F.lit(False))
    return rows.groupBy("mask", "event_type").agg(F.count("*").alias("n_total"), F.count_if(hidden).alias("n_withheld"), F.count_if(~hidden).alias("n_yielded"))


@query("""
, h AS (SELECT unnest(['a', 'b', 'c', 'd']) AS hypothesis),
p AS (SELECT hypothesis, user_id, CASE hypothesis WHEN 'a' THEN bearing WHEN 'b' THEN -bearing WHEN 'c' THEN 360 - bearing ELSE bearing + 90 END - value + 180 AS x FROM ev, h),
d AS (SELECT hypothesis, user_id, x - 360 * floor(x / 360) - 180 AS d FROM p),
s AS (SELECT hypothesis, user_id, round_even(sqrt(avg(d * d)), 5) AS rms FROM d GROUP BY ALL)
SELECT user_id, hypothesis, rms, row_number() OVER (PARTITION BY user_id ORDER BY rms, hypothesis) AS rank FROM s""")
def axis_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four signed axes as hypotheses, ranked by their wrapped residual."""
    b = F.col("bearing")
    h = F.explode(F.array(*[F.struct(F.lit(n).alias("hypothesis"), x.alias("x")) for n, x in (("a", b), ("b", -b), ("c", 360 - b), ("d", b + 90))]))
    rows = events(spark, sf_dir).select("user_id", "value", h.alias("h")).select("user_id", "h.hypothesis", (F.pmod(F.col("h.x") - F.col("value") + 180, F.lit(360.0)) - 180).alias("d"))
    s = rows.groupBy("user_id", "hypothesis").agg(r(F.sqrt(F.avg(F.col("d") * F.col("d"))), 5).alias("rms"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rms", "hypothesis")).cast("long"))


@query("""
, k AS (SELECT user_id, event_id, t_us, lat, lon, first_value(lat) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS lat0, first_value(lon) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS lon0 FROM ev),
m AS (SELECT *, sqrt(pow(radians(lon - lon0) * cos(radians(lat0)) * 6371000.0, 2) + pow(radians(lat - lat0) * 6371000.0, 2)) AS d, degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) AS b FROM k)
SELECT user_id, event_id, round_even(b - 360 * floor(b / 360), 4) AS heading FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS n FROM m WHERE d >= 3000) WHERE n = 1""")
def initial_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bearing of the first displacement of three kilometres at least."""
    from driftline.functions.geodesy import bearing, planar

    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    rows = events(spark, sf_dir).select("user_id", "event_id", "t_us", "lat", "lon", F.first("lat").over(w).alias("lat0"), F.first("lon").over(w).alias("lon0"))
    at = (F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    far = rows.withColumn("d", planar(*at)).filter("d >= 3000").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return far.select("user_id", "event_id", r(bearing(*at), 4).alias("heading"))
