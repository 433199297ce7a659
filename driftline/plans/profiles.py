"""Summaries, clocks, grids, ranks and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import finite
from driftline.functions.scalars import half_even as r
from driftline.operators import profiles, temporal
from driftline.sources.tables import channel, events, table

from . import query

INTERVALS = """
, dt AS (SELECT user_id, event_type, t_us, (t_us - lag(t_us) OVER (PARTITION BY user_id, event_type ORDER BY t_us, event_id)) / 1e6 AS dt_s, value FROM ev)
"""


def intervals(ev: DataFrame) -> DataFrame:
    """Seconds since the row before of the same session and channel."""
    w = Window.partitionBy("user_id", "event_type").orderBy("t_us", "event_id")
    return ev.withColumn("dt_s", (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(1e6))


@query(INTERVALS + """
SELECT event_type, count(dt_s) AS n, min(dt_s) AS low, quantile_disc(dt_s, 0.5) AS p50, quantile_disc(dt_s, 0.9) AS p90, quantile_disc(dt_s, 0.95) AS p95, quantile_disc(dt_s, 0.99) AS p99, max(dt_s) AS high
FROM dt GROUP BY event_type""")
def inter_arrival_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank profile of the times between a channel's samples, pooled over sessions."""
    dt = intervals(events(spark, sf_dir))
    return dt.groupBy("event_type").agg(F.count("dt_s").alias("n"), F.min("dt_s").alias("low"), *profiles.nearest_rank("dt_s", 0.5, 0.9, 0.95, 0.99), F.max("dt_s").alias("high"))


@query(INTERVALS + """
, b AS (SELECT unnest([3600.0, 7200.0, 14400.0, 28800.0, 86400.0, 172800.0, 345600.0, 604800.0])::DOUBLE AS bound)
SELECT event_type, bound, count(dt_s) AS n, count(*) FILTER (dt_s > bound) AS n_over, round_even(count(*) FILTER (dt_s > bound) / count(dt_s)::DOUBLE, 4) AS share_over,
  round_even(max(dt_s) FILTER (dt_s > bound), 6) AS max_over FROM dt, b GROUP BY ALL""")
def staleness_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a channel is silent for longer than each of eight bounds."""
    dt = intervals(events(spark, sf_dir)).select("event_type", "dt_s")
    return profiles.bounds_grid(dt, ["event_type"], "dt_s", [3600.0, 7200.0, 14400.0, 28800.0, 86400.0, 172800.0, 345600.0, 604800.0])


@query("""
, b AS (SELECT unnest([5.0, 20.0, 50.0, 100.0])::DOUBLE AS bound)
SELECT event_type, bound, count(*) FILTER (event_id % 7 <> 0) AS n_known, count(*) FILTER (event_id % 7 = 0) AS n_unknown, count(*) FILTER (event_id % 7 <> 0 AND value <= bound) AS n_within,
  round_even(count(*) FILTER (event_id % 7 <> 0 AND value <= bound) / count(*) FILTER (event_id % 7 <> 0)::DOUBLE, 4) AS share_within FROM ev, b GROUP BY ALL""")
def accuracy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known accuracies within each bound; every seventh counts as unknown."""
    known = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = events(spark, sf_dir).select("event_type", known.alias("x")).withColumn("bound", F.explode(F.array(*map(F.lit, [5.0, 20.0, 50.0, 100.0]))))
    within = F.count_if(F.col("x") <= F.col("bound"))
    return rows.groupBy("event_type", "bound").agg(F.count("x").alias("n_known"), (F.count("*") - F.count("x")).alias("n_unknown"), within.alias("n_within"), r(within / F.count("x"), 4).alias("share_within"))


@query("""
, b AS (SELECT unnest([4, 8, 12, 16])::BIGINT AS bound)
SELECT event_type, bound, count(*) FILTER (event_id % 20 >= bound) AS n_at_least, count(*) AS n FROM ev, b GROUP BY ALL""")
def satellite_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", (F.col("event_id") % 20).alias("x")).withColumn("bound", F.explode(F.array(*[F.lit(b).cast("long") for b in (4, 8, 12, 16)])))
    return rows.groupBy("event_type", "bound").agg(F.count_if(F.col("x") >= F.col("bound")).alias("n_at_least"), F.count("*").alias("n"))


@query("""
, n AS (SELECT event_type, floor(value)::BIGINT AS v, count(*) AS n FROM ev GROUP BY ALL)
SELECT * FROM (SELECT event_type, v, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, v) AS rank FROM n) WHERE rank <= 5""")
def repeat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest values of a channel."""
    return profiles.top_repeats(events(spark, sf_dir).select("event_type", F.floor("value").alias("v")), ["event_type"], "v", 5)


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 7 <> 0) AS n_present, count(*) FILTER (event_id % 7 = 0) AS n_null FROM ev GROUP BY event_type""")
def null_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count(x).alias("n_present"), (F.count("*") - F.count(x)).alias("n_null"))


@query("""
, x AS (SELECT event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS x FROM ev)
SELECT event_type, count(x) AS n, round_even(avg(x), 6) AS mean, round_even(quantile_cont(x, 0.5), 6) AS median, round_even(min(x), 6) AS low, round_even(max(x), 6) AS high,
  round_even(quantile_cont(x, 0.01), 6) AS p01, round_even(quantile_cont(x, 0.95), 6) AS p95, round_even(quantile_cont(x, 0.99), 6) AS p99, round_even(stddev_pop(x), 6) AS std FROM x GROUP BY event_type""")
def finite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finite values alone: every eleventh value is NaN here."""
    x = F.when(F.col("event_id") % 11 != 0, F.col("value")).otherwise(F.lit(float("nan")))
    return events(spark, sf_dir).select("event_type", finite(x).alias("x")).groupBy("event_type").agg(*profiles.summary(F.col("x")))


@query("""
SELECT user_id, count(*) AS n, round_even(avg(abs(lat - 12.9 - value / 1000)), 6) AS mae, round_even(sqrt(avg(pow(lat - 12.9 - value / 1000, 2))), 6) AS rmse,
  round_even(corr(lat - 12.9, value / 1000), 6) AS corr, round_even(regr_slope(lat - 12.9, value / 1000), 6) AS slope, round_even(regr_intercept(lat - 12.9, value / 1000), 6) AS intercept FROM ev GROUP BY user_id HAVING count(*) >= 3""")
def agreement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", (F.col("lat") - 12.9).alias("a"), (F.col("value") / 1000).alias("b"))
    return rows.groupBy("user_id").agg(*profiles.agreement("a", "b")).filter("n >= 3")


@query("""
, s AS (SELECT user_id, dt FROM (SELECT user_id, (t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS dt FROM ev) WHERE dt IS NOT NULL),
m AS (SELECT user_id, quantile_cont(dt, 0.5) FILTER (dt > 0) AS m FROM s GROUP BY user_id)
SELECT s.user_id, count(*) AS n_intervals, round_even(any_value(m), 4) AS median_dt, round_even(1 / any_value(m), 9) AS rate_hz, count(*) FILTER (dt = 0) AS n_repeated, count(*) FILTER (dt < 0) AS n_back,
  count(*) FILTER (dt > greatest(0.25, m * 2.5)) AS n_gaps, round_even(max(dt), 6) AS longest, coalesce(sum(floor(dt / m + 0.5) - 1) FILTER (dt > greatest(0.25, m * 2.5)), 0)::BIGINT AS missing
FROM s JOIN m USING (user_id) GROUP BY s.user_id""")
def clock_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, gaps and missing slots of each session's clock, in the order of arrival."""
    return profiles.clock_stats(events(spark, sf_dir).select("user_id", "event_id", "t_us"), ["user_id"], "event_id", "t_us", floor=0.25, factor=2.5)


@query("""
, l AS (SELECT user_id, t_us, event_id, floor(value / 50) AS v, lag(floor(value / 50)) OVER w AS p, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
c AS (SELECT *, sum(CASE WHEN k = 1 OR v <> p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
g AS (SELECT user_id, run, count(*) AS n, max(t_us) - min(t_us) AS hold FROM c GROUP BY ALL)
SELECT user_id, count(*) - 1 AS n_changes, round_even(1 - (count(*) - 1) / nullif(sum(n) - 1, 0)::DOUBLE, 6) AS unchanged, max(n) AS longest_run, round_even(avg(n), 6) AS mean_run, round_even(max(hold) / 1e6, 6) AS longest_hold_s FROM g GROUP BY user_id""")
def change_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a value changes, and how long it holds."""
    from driftline.operators.windows import islands

    rows = events(spark, sf_dir).select("user_id", "t_us", "event_id", F.floor(F.col("value") / 50).alias("v"))
    runs = islands(rows, ["user_id"], ["t_us", "event_id"], F.col("v")).groupBy("user_id", "run").agg(F.count("*").alias("n"), (F.max("t_us") - F.min("t_us")).alias("hold"))
    changes = F.count("*") - 1
    return runs.groupBy("user_id").agg(changes.alias("n_changes"), r(1 - changes / F.nullif(F.sum("n") - 1, F.lit(0))).alias("unchanged"), F.max("n").alias("longest_run"), r(F.avg("n")).alias("mean_run"), r(F.max("hold") / 1e6).alias("longest_hold_s"))


@query("""
, g AS (SELECT user_id, event_type, avg(value) AS v, count(*) AS n FROM ev GROUP BY ALL)
SELECT event_type, count(*) AS n, round_even(avg(v), 6) AS mean, round_even(coalesce(stddev_samp(v), 0), 6) AS std, round_even(quantile_cont(v, 0.5), 6) AS median, round_even(min(v), 6) AS low, round_even(max(v), 6) AS high FROM g GROUP BY event_type""")
def cross_drive_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One figure for each session, then its spread over the sessions."""
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return g.groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"), r(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("std"), r(F.percentile("v", 0.5)).alias("median"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high"))


@query("""
, g AS (SELECT user_id, event_type, round_even(avg(value), 6) AS mean, round_even(max(value), 6) AS high, count(*)::DOUBLE AS n FROM ev GROUP BY ALL)
SELECT user_id, event_type, metric, metric_value FROM (UNPIVOT g ON mean, high, n INTO NAME metric VALUE metric_value)""")
def metric_long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metrics as one row each."""
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(r(F.avg("value")).alias("mean"), r(F.max("value")).alias("high"), F.count("*").cast("double").alias("n"))
    return g.unpivot(["user_id", "event_type"], ["mean", "high", "n"], "metric", "metric_value")


@query("""
, k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id)::DOUBLE AS a, row_number() OVER (PARTITION BY user_id ORDER BY lat, event_id)::DOUBLE AS b FROM ev)
SELECT user_id, count(*) AS n, round_even(corr(a, b), 6) AS rho FROM k GROUP BY user_id""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.spearman(events(spark, sf_dir).select("user_id", "event_id", "value", "lat"), ["user_id"], "value", "lat", "event_id")


@query("""
, k AS (SELECT event_type, greatest(1, floor(count(*) OVER (PARTITION BY event_type) * 0.1))::BIGINT AS k, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS t, row_number() OVER (PARTITION BY event_type ORDER BY lat DESC, event_id) AS s FROM ev)
SELECT event_type, any_value(k) AS k, count(*) FILTER (t <= k AND s <= k) AS n_hit, round_even(count(*) FILTER (t <= k AND s <= k) / any_value(k)::DOUBLE, 6) AS recall FROM k GROUP BY event_type""")
def top_decile_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_share_recall(events(spark, sf_dir).select("event_type", "event_id", "value", "lat"), ["event_type"], "value", "lat", "event_id", 0.1)


@query("""
, c AS (SELECT user_id, sum(value) OVER w AS cum, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT unnest([1, 2, 4, 8])::BIGINT AS m),
d AS (SELECT a.user_id, m.m, (a.cum - 2 * b.cum + coalesce(c.cum, 0)) / m.m AS d FROM c a CROSS JOIN m JOIN c b ON b.user_id = a.user_id AND b.k = a.k - m.m LEFT JOIN c ON c.user_id = a.user_id AND c.k = a.k - 2 * m.m WHERE a.k >= 2 * m.m)
SELECT user_id, m, count(*) AS n, round_even(sqrt(0.5 * avg(d * d)), 5) AS deviation FROM d GROUP BY ALL""")
def allan_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allan deviation of each session's signal for clusters of 1, 2, 4 and 8 samples."""
    rows = events(spark, sf_dir).select("user_id", "value", F.struct("t_us", "event_id").alias("at"))
    return profiles.allan(rows, ["user_id"], "at", "value", [1, 2, 4, 8]).filter("n > 0")


@query("""
, m AS (SELECT user_id, degrees(atan2(avg(sin(radians(bearing))), avg(cos(radians(bearing))))) AS m FROM ev GROUP BY user_id),
d AS (SELECT user_id, bearing - m + 180 AS x FROM ev JOIN m USING (user_id))
SELECT user_id, round_even(sqrt(avg(pow(x - 360 * floor(x / 360) - 180, 2))), 5) AS rms_deg, count(*) AS n FROM d GROUP BY user_id""")
def circular_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profiles.circular_residual(events(spark, sf_dir).select("user_id", "bearing"), ["user_id"], "bearing")
    return out.groupBy("user_id").agg(r(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), 5).alias("rms_deg"), F.count("*").alias("n"))


@query("""
, f AS (SELECT user_id, event_type, count(*) AS n, stddev_pop(value) AS s FROM ev GROUP BY ALL)
SELECT event_type, round_even(sqrt(sum(n * s * s) / sum(n)), 6) AS pooled_std, sum(n)::BIGINT AS n FROM f GROUP BY event_type""")
def pooled_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("s"))
    return f.groupBy("event_type").agg(r(F.sqrt(F.sum(F.col("n") * F.col("s") * F.col("s")) / F.sum("n"))).alias("pooled_std"), F.sum("n").alias("n"))


@query("""
, e AS (SELECT user_id, t_us // 3600000000 AS hour, max_by(value, (t_us, event_id)) AS last_value, count(*) AS n FROM ev GROUP BY ALL)
SELECT * FROM e""")
def last_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value in each whole slot of time."""
    return events(spark, sf_dir).groupBy("user_id", F.expr("t_us div 3600000000").alias("hour")).agg(F.max_by("value", F.struct("t_us", "event_id")).alias("last_value"), F.count("*").alias("n"))


@query("""
, k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS k FROM ev)
SELECT user_id, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS high FROM k WHERE k <= 32 GROUP BY user_id""")
def recent_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of each session's 32 newest values: a bounded window of latencies."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t_us"), F.desc("event_id")))
    rows = events(spark, sf_dir).select("user_id", "value", "t_us", "event_id").withColumn("k", k).filter("k <= 32")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), *profiles.nearest_rank("value", 0.5, 0.95, 0.99), F.max("value").alias("high"))


@query("""
, m AS (SELECT user_id, t_us, max(t_us) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ev),
k AS (SELECT user_id, t_us FROM m WHERE newest IS NULL OR t_us > newest),
d AS (SELECT user_id, t_us, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us) AS dt FROM k)
SELECT user_id, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, min(dt) AS least_us, max(dt) AS most_us, round_even((count(*) - 1) * 1e6 / nullif(max(t_us) - min(t_us), 0), 9) AS hz FROM d GROUP BY user_id""")
def rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and extreme intervals of a clock, of its increasing times alone."""
    kept = temporal.strictly_increasing(events(spark, sf_dir).select("user_id", "event_id", "t_us"), ["user_id"], "event_id", "t_us")
    d = kept.withColumn("dt", F.col("t_us") - F.lag("t_us").over(Window.partitionBy("user_id").orderBy("t_us")))
    hz = (F.count("*") - 1) * 1e6 / F.nullif(F.max("t_us") - F.min("t_us"), F.lit(0))
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.min("dt").alias("least_us"), F.max("dt").alias("most_us"), r(hz, 9).alias("hz"))


@query("""
, f AS (SELECT user_id, (value >= 50)::INT AS t, (lat >= 12.95)::INT AS p, value, abs(lat - 12.9) * 1000 AS sigma FROM ev)
SELECT user_id, count(*) AS n, round_even(sum(t * p) / nullif(sum(p), 0)::DOUBLE, 6) AS "precision", round_even(sum(t * p) / nullif(sum(t), 0)::DOUBLE, 6) AS recall,
  round_even(CASE WHEN sum(t) = 0 AND sum(p) = 0 THEN 1.0 ELSE 2 * sum(t * p) / (sum(t) + sum(p))::DOUBLE END, 6) AS f1,
  round_even(avg((value <= sigma)::INT), 6) AS within_1, round_even(avg((value <= 2 * sigma)::INT), 6) AS within_2,
  count(*) FILTER (value < 5) AS n_0_5, count(*) FILTER (value >= 5 AND value < 15) AS n_5_15, count(*) FILTER (value >= 15 AND value < 30) AS n_15_30, count(*) FILTER (value >= 30 AND value < 1000) AS n_30
FROM f GROUP BY user_id""")
def drive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1, sigma coverage and bands of each session; F1 is 1 if nothing is positive."""
    t, p, s = (F.col("value") >= 50).cast("int"), (F.col("lat") >= 12.95).cast("int"), F.abs(F.col("lat") - 12.9) * 1000
    tp, st, sp = F.sum(t * p), F.sum(t), F.sum(p)
    band = lambda a, b: F.count_if((F.col("value") >= a) & (F.col("value") < b))
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), r(tp / F.nullif(sp, F.lit(0))).alias("precision"), r(tp / F.nullif(st, F.lit(0))).alias("recall"),
        r(F.when((st == 0) & (sp == 0), 1.0).otherwise(2 * tp / F.nullif(st + sp, F.lit(0)))).alias("f1"),
        r(F.avg((F.col("value") <= s).cast("int"))).alias("within_1"), r(F.avg((F.col("value") <= 2 * s).cast("int"))).alias("within_2"),
        F.count_if(F.col("value") < 5).alias("n_0_5"), band(5, 15).alias("n_5_15"), band(15, 30).alias("n_15_30"), band(30, 1000).alias("n_30"),
    )


@query("""
, h AS (SELECT event_type, user_id % 12 AS fold, value, lat * 8 AS predicted FROM ev)
SELECT event_type, fold, count(*) AS n, round_even(sqrt(avg(pow(predicted - value, 2))), 6) AS rmse FROM h GROUP BY ALL
UNION ALL SELECT event_type, NULL, count(*), round_even(sqrt(avg(pow(predicted - value, 2))), 6) FROM h GROUP BY event_type""")
def leave_one_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each fold and of all pooled, from one pass."""
    rows = events(spark, sf_dir).select("event_type", (F.col("user_id") % 12).alias("fold"), F.pow(F.col("lat") * 8 - F.col("value"), 2).alias("e"))
    return rows.rollup("event_type", "fold").agg(F.count("*").alias("n"), r(F.sqrt(F.avg("e"))).alias("rmse"), F.grouping("event_type").alias("g")).filter("g = 0").drop("g")


@query("""-- lineitem
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round_even(avg(l_discount), 6) AS mean_discount, round_even(sum(l_extendedprice * (1 - l_discount)) / 1000, 2) AS revenue_k
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and means by configuration and scenario, with the date pushed to the scan."""
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    money = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), r(F.avg("l_discount")).alias("mean_discount"), r(money, 2).alias("revenue_k"))


@query("""
, p AS (SELECT a.user_id, a.v - b.v AS d FROM (SELECT user_id, avg(value) AS v FROM ev WHERE event_type = 'purchase' GROUP BY 1) a JOIN (SELECT user_id, avg(value) AS v FROM ev WHERE event_type = 'signup' GROUP BY 1) b USING (user_id))
SELECT count(*) AS n, round_even(avg(d), 6) AS mean FROM p""")
def paired_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paired_differences(events(spark, sf_dir))
    return d.agg(F.count("*").alias("n"), r(F.avg("d")).alias("mean"))


def paired_differences(ev: DataFrame) -> DataFrame:
    a = channel(ev, "purchase").groupBy("user_id").agg(F.avg("value").alias("a"))
    b = channel(ev, "signup").groupBy("user_id").agg(F.avg("value").alias("b"))
    return a.join(b, "user_id").select("user_id", (F.col("a") - F.col("b")).alias("d"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the mean paired difference, resampled by whole sessions."""
    return profiles.bootstrap_mean(paired_differences(events(spark, sf_dir)), "d", "user_id")
