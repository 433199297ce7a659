"""Live streams of samples (session, channel, event_id, ts, value) and what is done to them.

State is bounded everywhere: by watermarks, by one row for each channel, or by
time-outs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.sources.storage import shared_path


def intake(stream: DataFrame, *, delay: str = "100 milliseconds", keys: tuple[str, ...] = ("session", "event_id")) -> DataFrame:
    """Valid samples, each id once within the watermark."""
    valid = stream.filter(F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    return valid.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def classified(stream: DataFrame, *, bound_us: int, gap_us: int) -> DataFrame:
    """Each sample with ``status``: OK, LATE (older than its channel's newest by more than ``bound_us``) or GAP (a step of over ``gap_us``).

    Lateness is by channel, which Spark's one watermark is not: the state is
    the newest time of each session and channel.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values("event_id", kind="stable")
        t = pdf["t_us"].to_numpy()
        # the newest time before each sample; the very first sample stands for its own
        before = np.maximum.accumulate(np.r_[t[0] if newest is None else newest, t])
        late, gap = before[:-1] - t > bound_us, t - before[:-1] > gap_us
        status = np.where(late, "LATE", np.where(gap, "GAP", "OK"))
        state.update((int(before[-1]),))
        yield pd.DataFrame({"session": key[0], "channel": key[1], "event_id": pdf["event_id"].to_numpy(), "status": status})

    return stream.groupBy("session", "channel").applyInPandasWithState(run, "session long, channel string, event_id long, status string", "newest long", "append", GroupStateTimeout.NoTimeout)


def throttled(stream: DataFrame, every: str, delay: str) -> DataFrame:
    """The last sample of each session and slot of time."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("last")
    out = stream.withWatermark("ts", delay).groupBy("session", F.window("ts", every)).agg(last, F.count("*").alias("n"))
    return out.select("session", F.col("window.start").alias("start"), "last.event_id", "last.value", "n")


def snapshot(stream: DataFrame) -> DataFrame:
    """Per session and channel: count, first and last time, latest value; for update or complete mode."""
    return stream.groupBy("session", "channel").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


def withheld(stream: DataFrame, masks: DataFrame) -> DataFrame:
    """Samples that no mask (session, start, end: a static table) holds: a stream-static join on the session, then a count of hits.

    The masks of a session are one array, so that a sample stays one row.
    """
    of = masks.groupBy(F.col("session").alias("_session")).agg(F.collect_list(F.struct("start", "end")).alias("_masks"))
    joined = stream.join(of, stream["session"] == of["_session"], "left")
    inside = F.exists("_masks", lambda m: (F.col("ts") >= m["start"]) & (F.col("ts") < m["end"]))
    return joined.filter(~F.coalesce(inside, F.lit(False))).drop("_session", "_masks")


def paired(left: DataFrame, right: DataFrame, within: str, delay: str) -> DataFrame:
    """Samples of two channels of a session at most ``within`` apart: a stream-stream join with bounded state."""
    a = left.withWatermark("ts", delay).select(F.col("session").alias("session"), F.col("ts").alias("ts_a"), F.col("event_id").alias("id_a"), F.col("value").alias("value_a"))
    b = right.withWatermark("ts", delay).select(F.col("session").alias("session_b"), F.col("ts").alias("ts_b"), F.col("event_id").alias("id_b"), F.col("value").alias("value_b"))
    on = (F.col("session") == F.col("session_b")) & (F.col("ts_b") >= F.col("ts_a") - F.expr(f"INTERVAL {within}")) & (F.col("ts_b") <= F.col("ts_a") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("session", "id_a", "id_b", F.greatest("ts_a", "ts_b").alias("ts"), "value_a", "value_b")


def read_events(spark: SparkSession, sf_dir: str, *, files: int | None = None) -> DataFrame:
    """The events table as a stream, some files at a time."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # a stream reads folders: the table is one, or a file in one
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):
        raw = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        raw = reader.parquet(path)
    t_us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return raw.select(F.col("user_id").alias("session"), F.col("event_type").alias("channel"), "event_id", F.timestamp_micros(t_us).alias("ts"), t_us.alias("t_us"), "value")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder, and read that.

    Append streams write files as they go; a complete one writes its last state.
    """
    spark = stream.sparkSession
    out, at = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(out)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
