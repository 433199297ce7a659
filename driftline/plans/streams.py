"""Streaming queries, run over the table as it is, with the batch answer as their SQL where it is the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.tables import HOUR_US, events, masks
from driftline.streaming import intake, live

from . import query


@query("""
, o AS (SELECT user_id, event_type, event_id, t_us, max(t_us) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ev)
SELECT user_id AS session, event_type AS channel, event_id, CASE WHEN newest - t_us > 3600000000 THEN 'LATE' WHEN t_us - newest > 432000000000 THEN 'GAP' ELSE 'OK' END AS status FROM o""")
def stream_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lateness and gaps by channel, with one state row for each."""
    return live.drained(live.classified(live.read_events(spark, sf_dir), bound_us=HOUR_US, gap_us=120 * HOUR_US))


@query("""
SELECT user_id AS session, event_type AS channel, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, max_by(value, (t_us, event_id)) AS latest FROM ev GROUP BY ALL""")
def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of every channel."""
    out = live.drained(live.snapshot(live.read_events(spark, sf_dir)), "complete")
    return out.select("session", "channel", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "latest")


@query("""
SELECT event_id, user_id AS session FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'error' AND x.user_id = ev.user_id AND ev.t_us >= x.t_us AND ev.t_us < x.t_us + 21600000000)""")
def stream_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream without what the masks hold."""
    m = masks(events(spark, sf_dir)).select(F.col("user_id").alias("session"), F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"))
    return live.drained(live.withheld(live.read_events(spark, sf_dir), m)).select("event_id", "session")


@query("""
SELECT a.user_id AS session, a.event_id AS id_a, b.event_id AS id_b FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.t_us - b.t_us) <= 7200000000 WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def stream_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of a session within two hours, stream with stream."""
    kind = lambda k: live.read_events(spark, sf_dir).filter(F.col("channel") == k)
    return live.drained(live.paired(kind("view"), kind("click"), "2 HOURS", "31 DAYS")).select("session", "id_a", "id_b")


@query("""
SELECT user_id AS session, event_id, value FROM ev""")
def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid samples, each once: here all of them."""
    return live.drained(live.intake(live.read_events(spark, sf_dir), delay="31 days")).select("session", "event_id", "value")


@query("""
, s AS (SELECT user_id AS session, t_us // 21600000000 * 21600000000 AS start_us, event_id, value, t_us FROM ev)
SELECT session, start_us, event_id, value, count(*) OVER (PARTITION BY session, start_us) AS n FROM s
QUALIFY row_number() OVER (PARTITION BY session, start_us ORDER BY t_us DESC, event_id DESC) = 1""")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sample of each six hours; draining flushes the slots that no watermark has passed."""
    out = live.drained(live.throttled(live.read_events(spark, sf_dir), "6 hours", "1 hour"), "complete")
    return out.select("session", F.unix_micros("start").alias("start_us"), "event_id", "value", "n")


@query("""
, c AS (SELECT ev.*, unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS again FROM ev),
x AS (SELECT user_id AS session, CASE WHEN again = 1 THEN 'relay' ELSE event_type END AS channel, event_id, t_us, again, t_us + (event_id * 37) % 50 * 60000000 AS received, CASE WHEN event_id % 23 > 0 THEN value END AS value,
  t_us + (event_id * 37) % 50 * 60000000 + CASE WHEN again = 1 THEN 7200000000 ELSE (event_id * 13) % 90 * 60000000 - 60000000 END AS offered FROM c),
y AS (SELECT *, CASE WHEN value IS NULL OR t_us < 1704067200000000 + 21600000000 THEN 'INVALID' WHEN t_us < 1704067200000000 + 86400000000 THEN 'LATE' END AS early FROM x),
-- ids are unique but for relayed copies, which come last: floors of the originals first
o AS (SELECT *, max(t_us) FILTER (early IS NULL) OVER (PARTITION BY session, channel ORDER BY offered, event_id, t_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM y WHERE again = 0),
p AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN t_us <= newest THEN 'DUPLICATE' WHEN received > offered OR offered - received > 3600000000 THEN 'LATE' ELSE 'ACCEPTED' END AS code, early IS NULL AND coalesce(t_us > newest, true) AS had FROM o),
-- a copy stands for a record that was not had; the others are repeats
r AS (SELECT y.*, p.had FROM y JOIN p USING (event_id) WHERE y.again = 1),
q AS (SELECT *, max(t_us) FILTER (early IS NULL AND NOT had) OVER (PARTITION BY session ORDER BY offered, event_id, t_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM r)
SELECT session, channel, event_id, t_us, code FROM p
UNION ALL SELECT session, channel, event_id, t_us, CASE WHEN early IS NOT NULL THEN early WHEN had OR t_us <= newest THEN 'DUPLICATE' WHEN offered - received > 3600000000 THEN 'LATE' ELSE 'ACCEPTED' END FROM q""")
def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the live intake with the code that it gets from both clocks, its channel's newest record and the ids before it."""
    return live.drained(intake.admitted(intake.two_clocks(live.read_events(spark, sf_dir)), most_lag_us=HOUR_US))
