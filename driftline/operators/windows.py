"""Runs, rolling frames, integrals, gradients, unwrapping and sliding windows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list[str], label: Column, name: str = "run") -> DataFrame:
    """Rows with the number of their run of equal labels (nulls equal), from 1 in each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = (~label.eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_segments(rows: DataFrame, keys: list[str], t: str, label: str, *, shortest: int, other: str) -> DataFrame:
    """Segments of one label: runs shorter than ``shortest`` become ``other``, like neighbours merge.

    A segment ends where the next one starts, so that they leave no gap; the last ends with its last row.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    runs = islands(rows, keys, [t], F.col(label)).groupBy(*keys, "run").agg(F.first(label).alias("_label"), F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("n"), F.sum("value").alias("total"))
    runs = runs.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("last")))
    runs = runs.withColumn("_label", F.when(F.col("end") - F.col("start") < shortest, F.lit(other)).otherwise(F.col("_label")))
    again = islands(runs.drop("run"), keys, ["start"], F.col("_label"))
    out = again.groupBy(*keys, "run").agg(F.first("_label").alias(label), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.drop("run")


def long_runs(rows: DataFrame, keys: list[str], order: str, flag: Column, at_least: int) -> DataFrame:
    """Rows with ``in_run``: whether they belong to a run of at least so many flagged rows."""
    marked = islands(rows.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, [order], F.col("_flag"))
    n = F.count("*").over(Window.partitionBy(*keys, "run"))
    return marked.withColumn("in_run", F.col("_flag") & (n >= at_least)).drop("_flag", "run")


def rolling_bandpower(x: str, w: Window, n: int) -> tuple[Column, Column]:
    """(detrended, the rolling mean of its squares): apply the first, then the second to its column."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.col(x) - F.avg(x).over(frame), F.avg(F.col("detrended") * F.col("detrended")).over(frame)


def centred_mean(x: str, w: Window, n: int) -> Column:
    """The mean over n rows around each, as many as there are; an even width reaches one further back."""
    return F.avg(x).over(w.rowsBetween(-(n // 2), n - 1 - n // 2))


def full_mean(x: str, w: Window, n: int) -> Column:
    """The mean over the last n rows, null before there are n."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def trapezoid(y: str, t: str, w: Window, scale: float = 1.0) -> Column:
    """The area of each step: sum it over the rows so far for the integral."""
    return F.coalesce(0.5 * (F.col(y) + F.lag(y).over(w)) * ((F.col(t) - F.lag(t).over(w)) / F.lit(scale)), F.lit(0.0))


def gradient(y: str, t: str, w: Window, scale: float = 1.0) -> Column:
    """Second-order differences for uneven steps, one-sided at the ends."""
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    a, b = (F.col(t) - F.lag(t).over(w)) / F.lit(scale), (F.lead(t).over(w) - F.col(t)) / F.lit(scale)
    inner = (a * a * y2 + (b * b - a * a) * y1 - b * b * y0) / (a * b * (a + b))
    return F.coalesce(inner, (y2 - y1) / b, (y1 - y0) / a)


def span_derivative(y: str, t: str, w: Window, span: int, longest: int, scale: float = 1.0) -> Column:
    """(k + span) less (k - span) over their time; null where a step between them is too long or not positive."""
    step = F.col("step")
    bad = F.sum(F.when((step <= 0) | (step > longest), 1).otherwise(0)).over(w.rowsBetween(-(span - 1), span))
    d = (F.lead(t, span).over(w) - F.lag(t, span).over(w)) / F.lit(scale)
    return F.when(bad == 0, (F.lead(y, span).over(w) - F.lag(y, span).over(w)) / d)


def unwrapped(angle: str, w: Window, turn: float = 360.0) -> Column:
    """What each row's jump over half a turn takes off: sum it over the rows so far and add it to the angle."""
    d = F.col(angle) - F.lag(angle).over(w)
    return F.coalesce(-turn * F.floor((d + turn / 2) / turn), F.lit(0.0))


def sliding(rows: DataFrame, keys: list[str], order: str, x: str, *, size: int, stride: int) -> DataFrame:
    """Means, spreads, jerk and shock of each window of ``size`` rows, every ``stride`` rows, at its last row."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame, inner = w.rowsBetween(-(size - 1), 0), w.rowsBetween(-(size - 2), 0)
    rows = rows.withColumn("_d", F.col(x) - F.lag(x).over(w)).withColumn("_rn", F.row_number().over(w))
    out = rows.withColumn("mean", F.avg(x).over(frame)).withColumn("std", F.stddev_pop(x).over(frame)).withColumn("jerk_rms", F.sqrt(F.avg(F.col("_d") * F.col("_d")).over(inner))).withColumn("shock", F.max(F.abs("_d")).over(inner))
    return out.filter((F.col("_rn") >= size) & ((F.col("_rn") - size) % stride == 0)).drop("_d", "_rn")


def gaps(rows: DataFrame, keys: list[str], t: str, bound: Column) -> DataFrame:
    """Outages: where the next row comes later than ``bound``, from then to it."""
    was = F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    return rows.withColumn("start", was + bound).withColumn("end", F.col(t)).filter(F.col("end") > F.col("start"))


def lateness(rows: DataFrame, keys: list[str], arrival: str, t: str, bound: int) -> Column:
    """Whether a row, in the order of arrival, is older than its channel's newest by more than ``bound``."""
    newest = F.max(t).over(Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(newest - F.col(t) > bound, F.lit(False))


def stride_of(n: int, most: int) -> int:
    """The step that leaves at most about ``most`` of n rows."""
    return max(1, n // most) if most else max(1, ceil(n))
