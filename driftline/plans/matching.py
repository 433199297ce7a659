"""Drives over a street grid: trellis and greedy matches of their fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import half_even as r
from driftline.operators import matching
from driftline.sources.tables import events, table

from . import query

#: Degrees of a block of the grid.
BLOCK = 0.001


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street grid that grows with the parts: each part is a corner with a road to the east and one to the north."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("p"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    i, j = F.col("p") % 40, F.floor(F.col("p") / 40)
    node = lambda a, b: a * 1_000_000 + b
    lat, lon = lambda b: F.lit(12.9) + b * BLOCK, lambda a: F.lit(77.5) + a * BLOCK
    way = F.when(F.col("up") == 1, i * 2 + 1).otherwise(j * 2)
    i2, j2 = i + 1 - F.col("up"), j + F.col("up")
    return p.select((F.col("p") * 2 + F.col("up")).alias("segment"), node(i, j).alias("u"), node(i2, j2).alias("v"), way.cast("long").alias("way"), lat(j).alias("lat1"), lon(i).alias("lon1"), lat(j2).alias("lat2"), lon(i2).alias("lon2"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fix for each event, five seconds apart: a session goes on by its values, turns every eighth row, and strays by the row's number."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    ev = events(spark, sf_dir).select("user_id", "event_id", "t_us", F.row_number().over(w).alias("k"), (F.lit(15.0) + F.col("value") % 40).alias("step"))
    side = (F.floor(F.col("k") / 8) + F.col("user_id")) % 2
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    east, north = (F.sum(F.when(side == s, F.col("step")).otherwise(0.0)).over(run) for s in (0, 1))
    stray = lambda a: ((F.col("event_id") * a) % 17 - 8) * F.lit(1e-5)
    return ev.select(
        "user_id", "event_id", (F.col("k") * 5.0 + F.when(F.col("k") > 40, 60.0).otherwise(0.0)).alias("t"), F.col("event_id").alias("fix"),
        (F.lit(12.9) + (F.col("user_id") % 20) * BLOCK + north / 111_000 + stray(13)).alias("lat"), (F.lit(77.5) + (F.col("user_id") % 17) * BLOCK + east / 108_500 + stray(7)).alias("lon"),
        F.when(F.col("event_id") % 5 > 0, F.when(side == 0, F.pi() / 2).otherwise(F.lit(0.0)) + ((F.col("event_id") % 9) - 4) / F.lit(20.0)).alias("heading"),
        (F.lit(8.0) + (F.col("event_id") * 11) % 46).alias("accuracy"), F.when(F.col("event_id") % 7 > 0, F.col("step") / 5).alias("speed"),
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.select("user_id", "kind", "fix", "t", "status", "segment", *[r(F.col(c), 5).alias(c) for c in ("confidence", "distance_m", "cross_m", "normal_east", "normal_north")], "n")


@query()
def trellis_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix on its road with the fixes so far, and five fixes later."""
    return _shown(matching.trellis_match(fixes(spark, sf_dir), streets(spark, sf_dir), "user_id"))


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix on its road by continuity with the last match."""
    return _shown(matching.greedy_match(fixes(spark, sf_dir), streets(spark, sf_dir), "user_id"))
