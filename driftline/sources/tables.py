"""The driver's tables, and the sensor log that stands on ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import epoch_us

HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t_us, and lat, lon and bearing derived by integer arithmetic.

    A user stands for a session, an event type for a channel, value for the
    signal. Unused columns are pruned at the scan.
    """
    ev = table(spark, sf_dir, "events")
    tenth = lambda a, b: ((F.col("user_id") * a + F.col("event_id") * b) % 1000) / F.lit(10000.0)
    return ev.select(
        "event_id", "user_id", "event_type", "value", "props", epoch_us("ts").alias("t_us"),
        (F.lit(12.9) + tenth(37, 13)).alias("lat"), (F.lit(77.5) + tenth(53, 7)).alias("lon"), ((F.col("event_id") * 29) % 360).cast("double").alias("bearing"),
    )


def channel(ev: DataFrame, kind: str) -> DataFrame:
    return ev.filter(F.col("event_type") == kind)


def masks(ev: DataFrame, hours: int = 6) -> DataFrame:
    """user_id, start_us, end_us: so many hours from each error on; they may overlap."""
    return channel(ev, "error").select("user_id", F.col("t_us").alias("start_us"), (F.col("t_us") + hours * HOUR_US).alias("end_us"))
