"""Inertial navigation of the sessions: the filter, its arms side by side, and propagation alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import half_even as r
from driftline.operators import inertial
from driftline.sources.tables import events

from . import query

STEP_S = 0.1

ARMS = (inertial.Arm("all"), inertial.Arm("fixes_only", off=("sideways", "forward", "heading")), inertial.Arm("blind", off=("position", "velocity")), inertial.Arm("loose", accel_noise=0.5, gyro_noise=0.05))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row each tenth of a second for each event: speed, yaw from east, and the way so far, all summed from the events' values and numbers."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ev = events(spark, sf_dir).select("user_id", "event_id", "event_type", "t_us", F.row_number().over(w).alias("k"), (F.avg("value").over(w.rowsBetween(-19, 0)) / 10).alias("speed"), (((F.col("event_id") * 7) % 21 - 10) / F.lit(20.0)).alias("turn"))
    ev = ev.withColumn("along", F.coalesce((F.col("speed") - F.lag("speed").over(w)) / STEP_S, F.lit(0.0))).withColumn("yaw", F.sum(F.when(F.col("k") > 1, F.col("turn")).otherwise(0.0) * STEP_S).over(run))
    step = F.when(F.col("k") > 1, F.col("speed")).otherwise(0.0) * STEP_S
    return ev.withColumn("east", F.sum(step * F.cos("yaw")).over(run)).withColumn("north", F.sum(step * F.sin("yaw")).over(run)).withColumn("t", F.col("k") * STEP_S)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aligned start, a sample for each row, and a measurement that the event's type names, astray by the row's number."""
    m = motion(spark, sf_dir)
    noise = lambda a, size: ((F.col("event_id") * a) % 19 - 9) * (size / 9)
    doubles = lambda *x: F.array(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in x])
    row = lambda kind, z, r_: F.struct(F.lit(kind).alias("kind"), z.alias("z"), r_.alias("r"))
    align = row("align", doubles(F.col("speed"), 0, 0, 1, 0, 0, 0, 12.95, 77.55, 900), doubles(9, 1, 0.02, 1e-4, 1e-2))
    sample = row("sample", doubles(F.col("along") + noise(11, 0.05), F.col("speed") * F.col("turn") + noise(5, 0.05), F.lit(9.78) + noise(3, 0.02), noise(2, 0.002), noise(17, 0.002), F.col("turn") + noise(8, 0.002)), doubles())
    measured = (
        F.when(F.col("event_type") == "view", row("position", doubles(F.col("east") + noise(13, 3.0), F.col("north") + noise(7, 3.0)), doubles(9, 9)))
        .when(F.col("event_type") == "click", row("velocity", doubles(F.col("speed") + noise(3, 0.3), F.pi() / 2 - F.col("yaw")), doubles(1)))
        .when(F.col("event_type") == "signup", row("sideways", doubles(1, 0, 0, 0), doubles(0.25, 0.25)))
        .when(F.col("event_type") == "error", row("heading", doubles(noise(5, 0.02)), doubles(0.01)))
        .otherwise(row("forward", doubles(F.col("speed") + noise(9, 0.2), 1, 0, 0, 0), doubles(0.5)))
    )
    each = F.when(F.col("k") == 1, F.array(align, measured)).otherwise(F.array(sample, measured))
    return m.select("user_id", "t", F.explode(each).alias("x")).select("user_id", "t", "x.*")


def _state(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("user_id", "t", *columns, *[r(F.col(c), 4).alias(c) for c in ("nis", "px", "py", "pz", "vx", "vy", "vz", "sigma_p", "sigma_v", "sigma_yaw")], *[r(F.col(c), 6).alias(c) for c in ("qw", "qx", "qy", "qz", "bgz", "bax")])


@query()
def inertial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each measurement of a session, and the filter's state after it."""
    return _state(inertial.navigated(rows(spark, sf_dir), "user_id"), "kind", "outcome")


@query()
def inertial_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four settings over one reading of the rows: outcomes of each session's measurements and where each ends."""
    out = inertial.navigated(rows(spark, sf_dir), "user_id", arms=ARMS)
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    last = lambda c: r(F.max_by(c, "t"), 3).alias(c)
    return out.groupBy("user_id", "arm").agg(count("accepted"), count("gate"), count("off"), count("failed"), last("px"), last("py"), last("sigma_p"))


@query()
def strapdown_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attitude, velocity and place of each session from its samples alone, with the Earth's rate and gravity."""
    out = inertial.navigated(rows(spark, sf_dir).filter("kind IN ('align', 'sample')"), "user_id", covariance=False, samples=True)
    return out.select("user_id", "t", "outcome", *[r(F.col(c), 4).alias(c) for c in ("px", "py", "pz", "vx", "vy", "vz")], *[r(F.col(c), 6).alias(c) for c in ("qw", "qx", "qy", "qz")])
