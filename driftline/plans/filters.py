"""Validation, masks, admission and quality policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.geodesy import valid_coordinates
from driftline.functions.scalars import half_even as r
from driftline.operators import temporal, validation
from driftline.sources.tables import HOUR_US, events, masks, table

from . import query

MASKS = """
, x AS (SELECT user_id, t_us AS s, t_us + 21600000000 AS e FROM ev WHERE event_type = 'error')
"""


@query("""
SELECT event_id, concat_ws(';', CASE WHEN value < 0 OR value > 150 THEN 'VALUE' END, CASE WHEN NOT (event_type IN ('view', 'click', 'purchase')) THEN 'TYPE' END,
  CASE WHEN bearing >= 300 THEN 'HEADING' END, CASE WHEN try_cast(json_extract_string(props, '$.k') AS BIGINT) < 5 THEN 'PROPS' END) AS codes FROM ev""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every row, from a table of rules."""
    checks = {
        "VALUE": validation.rule("nonneg", F.col("value")) & (F.col("value") <= 150),
        "TYPE": F.col("event_type").isin("view", "click", "purchase"),
        "HEADING": validation.rule("heading", F.col("bearing")) & (F.col("bearing") < 300),
        "PROPS": F.get_json_object("props", "$.k").try_cast("long") >= 5,
    }
    return events(spark, sf_dir).select("event_id", F.array_join(validation.errors(checks), ";").alias("codes"))


@query("""
SELECT event_id, CASE WHEN value > 150 THEN 'SPEED' WHEN lat > 12.99 THEN 'COVERAGE' WHEN event_type = 'error' THEN 'STATE' END AS refused FROM ev""")
def refusal_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing reason, null for accepted rows."""
    checks = {"SPEED": F.col("value") <= 150, "COVERAGE": F.col("lat") <= 12.99, "STATE": F.col("event_type") != "error"}
    return events(spark, sf_dir).select("event_id", validation.first_error(checks).alias("refused"))


@query("""
SELECT user_id, count(*) AS n, count(*) - count(DISTINCT t_us // 3600000000) AS n_repeated, count(DISTINCT event_type) AS n_headers, count(*) > 70 AS too_many FROM ev GROUP BY user_id""")
def stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids (here: hours), headers and limits of each stream."""
    rows = events(spark, sf_dir).select("user_id", F.expr("t_us div 3600000000").alias("hour"), "event_type")
    return validation.stream_guard(rows, "user_id", "hour", F.col("event_type"), 70)


@query("""
, i AS (SELECT user_id, event_id, t_us AS s, t_us + (value * 1000000000)::BIGINT - 1000000000 AS e, event_type AS p FROM ev),
l AS (SELECT *, lag(s) OVER w AS s0, lag(e) OVER w AS e0, lag(p) OVER w AS p0 FROM i WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, concat_ws(';', CASE WHEN NOT (s < e) THEN 'EMPTY' END, CASE WHEN s <= s0 THEN 'UNORDERED' END, CASE WHEN s < e0 THEN 'OVERLAP' END,
  CASE WHEN s = e0 AND p IS NOT DISTINCT FROM p0 THEN 'UNMERGED' END) AS codes FROM l""")
def annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and overlap of intervals, as they are listed."""
    length = (F.round(F.col("value") * 1_000_000_000)).cast("long") - 1_000_000_000
    rows = events(spark, sf_dir).select("user_id", "event_id", F.col("t_us").alias("start"), (F.col("t_us") + length).alias("end"), "event_type")
    out = validation.interval_findings(rows, ["user_id"], "event_id", "start", "end", "event_type")
    return out.select("event_id", "user_id", F.array_join("findings", ";").alias("codes"))


@query("""
, s AS (SELECT user_id, min(t_us) AS a, max(t_us) AS b FROM ev WHERE event_type <> 'error' GROUP BY user_id)
SELECT ev.event_id, ev.user_id, ev.t_us >= s.a AND ev.t_us + 21600000000 <= s.b AS inside FROM ev JOIN s USING (user_id) WHERE event_type = 'error'""")
def interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each interval lies within its session."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    s = ev.filter("event_type <> 'error'").groupBy("user_id").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    out = ev.filter("event_type = 'error'").join(s, "user_id")
    return out.select("event_id", "user_id", ((F.col("t_us") >= F.col("a")) & (F.col("t_us") + 6 * HOUR_US <= F.col("b"))).alias("inside"))


@query(MASKS + """
SELECT event_id, user_id, t_us FROM ev WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = ev.user_id AND ev.t_us >= x.s AND ev.t_us < x.e)""")
def mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples outside every mask."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    return temporal.masked(ev, masks(ev), ["user_id"], "t_us", "start_us", "end_us", width=6 * HOUR_US).select("event_id", "user_id", "t_us")


@query(MASKS + """
, k AS (SELECT ev.*, event_type = 'view' AND EXISTS (SELECT 1 FROM x WHERE x.user_id = ev.user_id AND ev.t_us >= x.s AND ev.t_us < x.e) AS hidden FROM ev)
SELECT user_id, count(*) AS n_total, count(*) FILTER (hidden) AS n_suppressed, count(*) FILTER (NOT hidden) AS n_yielded FROM k GROUP BY user_id""")
def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays that drop one channel inside the masks, and how much that is."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    held = temporal.range_join(ev.filter("event_type = 'view'"), masks(ev), ["user_id"], "t_us", "start_us", "end_us", width=6 * HOUR_US, how="left_semi").groupBy("user_id").agg(F.count("*").alias("h"))
    n = ev.groupBy("user_id").agg(F.count("*").alias("n_total")).join(held, "user_id", "left")
    h = F.coalesce("h", F.lit(0))
    return n.select("user_id", "n_total", h.alias("n_suppressed"), (F.col("n_total") - h).alias("n_yielded"))


@query(MASKS + """
, m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM x),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(s) AS start_us, max(e) AS end_us FROM g GROUP BY user_id, run""")
def merged_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.merged(masks(events(spark, sf_dir)), ["user_id"], "start_us", "end_us")


@query(MASKS + """
, m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM x),
g AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m) GROUP BY user_id, run),
t AS (SELECT user_id, max(t_us) - min(t_us) AS span FROM ev GROUP BY user_id)
SELECT t.user_id, span, coalesce(sum(e - s), 0)::BIGINT AS covered FROM t LEFT JOIN g USING (user_id) GROUP BY ALL""")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length under intervals and span of each session."""
    ev = events(spark, sf_dir).select("user_id", "event_type", "t_us")
    g = temporal.merged(masks(ev), ["user_id"], "start_us", "end_us").groupBy("user_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("covered"))
    span = ev.groupBy("user_id").agg((F.max("t_us") - F.min("t_us")).alias("span"))
    return span.join(g, "user_id", "left").select("user_id", "span", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


@query("""
, f AS (SELECT user_id, count(*) AS n, stddev_pop(value) AS s, max(lat) AS top, count(*) FILTER (event_type = 'error') AS bad FROM ev GROUP BY user_id),
k AS (SELECT user_id, (n >= 60)::INT + (s <= 60)::INT + (top <= 12.999)::INT + (bad <= 16)::INT AS met,
  concat_ws('; ', CASE WHEN NOT n >= 60 THEN 'ROWS' END, CASE WHEN NOT s <= 60 THEN 'SPREAD' END, CASE WHEN NOT top <= 12.999 THEN 'COVERAGE' END, CASE WHEN NOT bad <= 16 THEN 'ERRORS' END) AS reasons FROM f)
SELECT user_id, CASE WHEN met = 4 THEN 'approved' WHEN met = 3 THEN 'conditional' ELSE 'quarantined' END AS disposition, reasons FROM k""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four criteria for each session, with the reasons against it."""
    f = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("s"), F.max("lat").alias("top"), F.count_if(F.col("event_type") == "error").alias("bad"))
    disposition, reasons = validation.admission({"ROWS": F.col("n") >= 60, "SPREAD": F.col("s") <= 60, "COVERAGE": F.col("top") <= 12.999, "ERRORS": F.col("bad") <= 16}, 3)
    return f.select("user_id", disposition.alias("disposition"), reasons.alias("reasons"))


@query("""
, f AS (SELECT user_id, (avg(value) > 50)::INT + (stddev_pop(value) < 52)::INT + (count(*) > 65)::INT AS met FROM ev GROUP BY user_id)
SELECT user_id, CASE met WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM f""")
def confidence_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    met = (F.col("m") > 50).cast("int") + (F.col("s") < 52).cast("int") + (F.col("n") > 65).cast("int")
    return f.select("user_id", F.when(met == 3, "high").when(met == 2, "medium").otherwise("low").alias("confidence"))


@query("""
, g AS (SELECT event_id, (t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id)) / 3.6e9 AS age_h, value FROM ev),
k AS (SELECT event_id, age_h, value, concat_ws(';', CASE WHEN age_h IS NULL THEN 'NO_FIX' END, CASE WHEN age_h > 24 THEN 'STALE' END, CASE WHEN value > 120 THEN 'INACCURATE' END, CASE WHEN event_id % 20 < 4 THEN 'FEW_SATELLITES' END) AS reasons FROM g)
SELECT event_id, CASE WHEN reasons = '' THEN 'GOOD' WHEN age_h IS NULL OR age_h > 24 THEN 'UNAVAILABLE' ELSE 'DEGRADED' END AS state, reasons FROM k""")
def quality_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered reasons; the first decides the state."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    age = (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(float(HOUR_US))
    rows = events(spark, sf_dir).select("event_id", "value", age.alias("age"))
    reasons = validation.errors({"NO_FIX": F.col("age").isNotNull(), "STALE": F.col("age").isNull() | (F.col("age") <= 24), "INACCURATE": F.col("value") <= 120, "FEW_SATELLITES": F.col("event_id") % 20 >= 4})
    rows = rows.select("event_id", reasons.alias("r"))
    state = F.when(F.size("r") == 0, "GOOD").when(F.col("r")[0].isin("NO_FIX", "STALE"), "UNAVAILABLE").otherwise("DEGRADED")
    return rows.select("event_id", state.alias("state"), F.array_join("r", ";").alias("reasons"))


@query("""
SELECT event_id, CASE WHEN value BETWEEN 0 AND 120 THEN value END AS speed, CASE WHEN bearing < 350 THEN bearing END AS bearing FROM ev""")
def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid optional values become null, never zero."""
    return events(spark, sf_dir).select("event_id", F.when(F.col("value").between(0, 120), F.col("value")).alias("speed"), F.when(F.col("bearing") < 350, F.col("bearing")).alias("bearing"))


@query("""
SELECT event_id, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AND event_id % 13 <> 0 AS valid FROM ev""")
def coordinate_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth latitude counts as NaN here."""
    lat = F.when(F.col("event_id") % 13 != 0, F.col("lat")).otherwise(F.lit(float("nan")))
    return events(spark, sf_dir).select("event_id", valid_coordinates(lat, F.col("lon")).alias("valid"))


@query("""
, b AS (SELECT user_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM ev GROUP BY user_id)
SELECT user_id, a >= 12.901 AND b <= 12.999 AND c >= 77.501 AND d <= 77.5995 AS within FROM b""")
def coverage_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a whole session lies within the mapped area."""
    b = events(spark, sf_dir).groupBy("user_id").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    return b.select("user_id", F.expr("a >= 12.901 AND b <= 12.999 AND c >= 77.501 AND d <= 77.5995").alias("within"))


@query("""
, o AS (SELECT event_id, user_id, event_type, t_us, max(t_us) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest,
  row_number() OVER (PARTITION BY user_id, t_us // 3600000000 ORDER BY event_id) AS k FROM ev)
SELECT event_id, CASE WHEN t_us < newest THEN 'LATE' WHEN k > 1 THEN 'DUPLICATE' END AS rejection, 'channel:' || event_type AS channel FROM o""")
def input_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late and duplicate records, with their channel's key."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t_us")
    newest = F.max("t_us").over(Window.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    k = F.row_number().over(Window.partitionBy("user_id", F.expr("t_us div 3600000000")).orderBy("event_id"))
    rows = rows.withColumn("newest", newest).withColumn("k", k)
    return rows.select("event_id", F.when(F.col("t_us") < F.col("newest"), "LATE").when(F.col("k") > 1, "DUPLICATE").alias("rejection"), F.concat(F.lit("channel:"), "event_type").alias("channel"))


@query("""-- orders
SELECT md5(o_orderstatus || o_orderpriority || (o_orderkey % 97)::VARCHAR) AS id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that more than one directory claims."""
    id_ = F.md5(F.concat("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 97).cast("string")).cast("binary"))
    return table(spark, sf_dir, "orders").groupBy(id_.alias("id")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")).filter("n > 1")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (value > 150) AS n_bad, round_even(count(*) FILTER (value > 150) / count(*)::DOUBLE, 6) AS share_bad, round_even(count(*) FILTER (value <= 150 AND lat < 12.95) / count(*)::DOUBLE, 6) AS share_pass FROM ev GROUP BY event_type""")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows count in the denominator of every rate."""
    bad, ok = F.count_if(F.col("value") > 150), F.count_if((F.col("value") <= 150) & (F.col("lat") < 12.95))
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), bad.alias("n_bad"), r(bad / F.count("*")).alias("share_bad"), r(ok / F.count("*")).alias("share_pass"))
