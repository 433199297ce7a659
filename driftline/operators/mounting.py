"""How a device sits in its vehicle, in three dimensions, from what it felt over the first part of a drive.

Vehicle axes: x forward, y left, z up. Each pass is an aggregate of a session's rows that Spark
combines before its shuffle, and needs only the few numbers of the pass before it:

1. samples near a standstill (or all of a window, if it has none) give the up direction and, at a standstill, the gyro's bias;
2. horizontal specific force and turn rate about that direction, averaged around each fix, against the
   change of speed (forward) and speed times turn rate (left) give the rotation about up, with its correlations.

A window that cannot tell is refused with a code, its numbers stay for the report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import rotations
from driftline.operators import calibration

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Limits:
    """What a window must have; times in the unit of the samples' clock."""

    stopped: float = 0.3
    least_stops: int = 4
    least_still: int = 50
    moving: float = 3.0
    least_moving: int = 30
    excitation: float = 0.08
    least_r: float = 0.5
    least_samples: int = 100
    least_fixes: int = 5
    half: float = 0.5
    longest_gap: float = 3.0


def near_stops(samples: DataFrame, fixes: DataFrame, session: str, limits: Limits) -> DataFrame:
    """``samples`` with stop, the nearest time of a stopped fix within ``half`` (the earlier one's time if both sides have one), else null.

    One union and one sort of each session instead of a join.
    """
    stops = fixes.filter(F.col("speed") < limits.stopped).select(session, "t", F.col("t").alias("_stop"))
    both = samples.select(session, "t", *AXES, F.lit(None).cast("double").alias("_stop"), F.lit(True).alias("_mine")).unionByName(
        stops.select(session, "t", *[F.lit(None).cast("double").alias(a) for a in AXES], "_stop", F.lit(False).alias("_mine"))
    )
    # equal times see each other: ranges, not rows
    w = Window.partitionBy(session).orderBy("t")
    before = F.max("_stop").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("_stop").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.select(session, "t", *AXES, "_mine", before.alias("_a"), after.alias("_b")).filter("_mine")
    close = F.when(F.col("t") - F.col("_a") <= limits.half, F.col("_a")).when(F.col("_b") - F.col("t") <= limits.half, F.col("_b"))
    return near.select(session, "t", *AXES, close.alias("stop"))


def interval_means(samples: DataFrame, fixes: DataFrame, session: str, half: float, prefix: str) -> DataFrame:
    """session, window, t of each fix and the means of the samples in [t - half, t + half) that the window has; fixes without any are left out.

    An equi-join on bins of the interval's length: an interval touches two of them.
    """
    size = 2 * half
    bins = lambda c: F.floor(c / size)
    f = fixes.select(session, "window", "t", F.explode(F.sequence(bins(F.col("t") - half), bins(F.col("t") + half))).alias("_bin"))
    s = samples.select(session, F.col("t").alias("_t"), *AXES, bins(F.col("t")).alias("_bin"))
    met = f.join(s, [session, "_bin"]).filter((F.col("_t") >= F.col("t") - half) & (F.col("_t") < F.col("t") + half) & (F.col("_t") <= F.col("window")))
    return met.groupBy(session, "window", "t").agg(*[F.avg(a).alias(prefix + a) for a in AXES])


def _in_windows(rows: DataFrame, windows: list[float]) -> DataFrame:
    each = F.explode(F.array(*[F.lit(float(x)) for x in windows]))
    return rows.withColumn("window", each).filter(F.col("t") <= F.col("window"))


def _still(samples: DataFrame, session: str, windows: list[float], prefix: str) -> DataFrame:
    """Number and means of a window's samples, of all and of those near a stop that the window has."""
    near = F.col("stop") <= F.col("window")
    rows = _in_windows(samples, windows)
    return rows.groupBy(session, "window").agg(
        F.count("*").alias(prefix + "n"), F.count_if(near).alias(prefix + "still"), *[F.avg(a).alias(f"{prefix}all_{a}") for a in AXES], *[F.avg(F.when(near, F.col(a))).alias(f"{prefix}still_{a}") for a in AXES]
    )


def solved(accel: DataFrame, gyro: DataFrame, fixes: DataFrame, session: str, windows: list[float], limits: Limits | None = None) -> DataFrame:
    """session, window, status, up, bias, theta, r_long, r_lat, moving and q (vehicle from device) of every window of a session.

    Samples are (session, t, x, y, z), fixes (session, t, speed); t counts from the session's beginning. ``status`` is ``valid``, or the
    first of ``data``, ``moving``, ``excitation``, ``r_long`` that refuses. Sessions without a fix have no row; rows with a null time or value are left out.
    """
    lim = limits or Limits()
    accel, gyro = (s.select(session, F.col("t").cast("double").alias("t"), *[F.col(a).cast("double").alias(a) for a in AXES]).dropna(subset=["t", *AXES]) for s in (accel, gyro))
    fixes = fixes.select(session, F.col("t").cast("double").alias("t"), F.col("speed").cast("double").alias("speed")).dropna(subset=["t", "speed"])
    w = Window.partitionBy(session).orderBy("t")
    fixes = fixes.select("*", *[f(c).over(w).alias(n) for n, f, c in (("t0", F.lag, "t"), ("t1", F.lead, "t"), ("v0", F.lag, "speed"), ("v1", F.lead, "speed"))])
    held = _in_windows(fixes, windows)
    of_fixes = held.groupBy(session, "window").agg(F.count("*").alias("n_fixes"), F.count_if(F.col("speed") < lim.stopped).alias("n_stops"))
    a = _still(near_stops(accel, fixes, session, lim), session, windows, "a_")
    g = _still(near_stops(gyro, fixes, session, lim), session, windows, "g_")
    first = of_fixes.join(a, [session, "window"], "left").join(g, [session, "window"], "left")
    at_rest = (F.col("n_stops") >= lim.least_stops) & (F.coalesce("a_still", F.lit(0)) >= lim.least_still)
    up = F.array(*[F.when(at_rest, F.col(f"a_still_{x}")).otherwise(F.col(f"a_all_{x}")) for x in AXES])
    bias = F.array(*[F.when(at_rest, F.coalesce(f"g_still_{x}", F.lit(0.0))).otherwise(F.lit(0.0)) for x in AXES])
    first = first.select(session, "window", "n_fixes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a_n", "g_n")], at_rest.alias("at_rest"), up.alias("_up"), bias.alias("bias"))
    first = first.withColumn("_size", rotations.norm(F.col("_up"))).withColumn("u", F.when(F.col("_size") > 0, F.transform("_up", lambda c: c / F.col("_size"))))
    helper = F.when(F.abs(F.col("u")[0]) < 0.9, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    first = first.withColumn("_e", rotations.cross(helper, F.col("u"))).withColumn("_length", rotations.norm(F.col("_e")))
    first = first.withColumn("e1", F.transform("_e", lambda c: c / F.col("_length"))).withColumn("e2", rotations.cross(F.col("u"), F.col("e1"))).drop("_up", "_size", "_e", "_length")
    inner = held.filter(F.col("t0").isNotNull() & (F.col("t1") <= F.col("window")))
    rows = inner.join(interval_means(accel, inner, session, lim.half, "m_"), [session, "window", "t"]).join(interval_means(gyro, inner, session, lim.half, "w_"), [session, "window", "t"])
    gap = F.col("t1") - F.col("t0")
    rows = rows.filter((F.col("speed") >= lim.moving) & (gap > 0) & (gap <= lim.longest_gap)).withColumn("along", (F.col("v1") - F.col("v0")) / gap)
    dot = lambda p, v: sum((F.col(p + x) * v[i] for i, x in enumerate(AXES)), F.lit(0.0))
    turn = sum(((F.col("w_" + x) - F.col("bias")[i]) * F.col("u")[i] for i, x in enumerate(AXES)), F.lit(0.0))
    rows = rows.join(first.select(session, "window", "u", "bias", "e1", "e2"), [session, "window"])
    rows = rows.select(session, "window", "along", dot("m_", F.col("e1")).alias("h1"), dot("m_", F.col("e2")).alias("h2"), (F.col("speed") * turn).alias("left"))
    cov = lambda x, y: F.covar_pop(x, y).alias(f"{x}_{y}")
    fit = rows.groupBy(session, "window").agg(F.count("*").alias("moving"), *[cov(x, y) for x, y in (("along", "along"), ("left", "left"), ("h1", "h1"), ("h2", "h2"), ("h1", "h2"), ("along", "h1"), ("along", "h2"), ("left", "h1"), ("left", "h2"))])
    fit = fit.withColumn("theta", F.atan2(F.col("left_h1") - F.col("along_h2"), F.col("along_h1") + F.col("left_h2")))
    c, s = F.cos("theta"), F.sin("theta")
    forward = _correlation(c * F.col("along_h1") - s * F.col("along_h2"), c * c * F.col("h1_h1") - 2 * s * c * F.col("h1_h2") + s * s * F.col("h2_h2"), F.col("along_along"))
    sideways = _correlation(s * F.col("left_h1") + c * F.col("left_h2"), s * s * F.col("h1_h1") + 2 * s * c * F.col("h1_h2") + c * c * F.col("h2_h2"), F.col("left_left"))
    fit = fit.select(session, "window", "moving", "theta", forward.alias("r_long"), sideways.alias("r_lat"), F.sqrt("along_along").alias("excitation"))
    out = first.join(fit, [session, "window"], "left").withColumn("moving", F.coalesce("moving", F.lit(0)))
    status = (
        F.when((F.col("a_n") < lim.least_samples) | (F.col("g_n") < lim.least_samples) | (F.col("n_fixes") < lim.least_fixes), "data")
        .when(F.col("moving") < lim.least_moving, "moving").when(F.col("excitation") < lim.excitation, "excitation")
        .when(F.coalesce(F.col("r_long") >= lim.least_r, F.lit(False)), "valid").otherwise("r_long")
    )
    axis = lambda p, q: F.array(*[p * F.col("e1")[i] + q * F.col("e2")[i] for i in range(3)])
    out = out.withColumn("_m", F.array(axis(F.cos("theta"), -F.sin("theta")), axis(F.sin("theta"), F.cos("theta")), F.col("u")))
    return out.select(session, "window", status.alias("status"), "at_rest", F.col("u").alias("up"), "bias", "theta", "r_long", "r_lat", "moving", F.when(F.col("theta").isNotNull(), rotations.quat_of_matrix(F.col("_m"))).alias("q"))


def _correlation(cov: Column, a: Column, b: Column) -> Column:
    return cov / F.nullif(F.sqrt(F.greatest(a, F.lit(0.0)) * b), F.lit(0.0))


def released(solutions: DataFrame, session: str) -> DataFrame:
    """Each session's first valid window, with what the earlier ones were refused for; sessions without one keep their refusals."""
    refused = solutions.groupBy(session).agg(F.sort_array(F.collect_list(F.when(F.col("status") != "valid", F.struct("window", "status")))).alias("refused"))
    first = calibration.first_valid(solutions, [session], "window", F.col("status") == "valid")
    known = F.filter("refused", lambda x: F.col("window").isNull() | (x["window"] < F.col("window")))
    return first.join(refused, session).select(*first.columns, F.concat_ws(",", F.transform(known, lambda x: x["status"])).alias("refused"))
